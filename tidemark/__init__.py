"""Candle analytics on Spark: DataFrame in, DataFrame out, at any number of series."""

import sys

from pyspark import cloudpickle

# Executors need not have the package: the few functions that run there travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
