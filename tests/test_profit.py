import numpy as np
import pytest

from tests.conftest import column
from tidemark.plans.profit import add_sub_horizons


@pytest.mark.parametrize(("window", "quantiles"), [(60, 50), (7, 10), (20, 4)])
def test_sub_horizons_by_steps_equal_whole_frames(series, window, quantiles):
    rng = np.random.default_rng(3)
    high = rng.integers(0, 12, 130).astype(float)  # with ties: the first extreme counts
    low = high - rng.integers(1, 5, 130)
    out = add_sub_horizons(series(high=high, low=low), window, quantiles)
    for i in (1, quantiles // 2, quantiles):
        n = int(i * window / quantiles)
        got = column(out, *[f"q{i}_{c}" for c in ("max_high", "max_high_distance", "min_low", "min_low_distance")])
        for k, row in enumerate(got):
            h, lo = high[k + 1 : k + 1 + n], low[k + 1 : k + 1 + n]
            want = (h.max(), h.argmax(), lo.min(), lo.argmin()) if n and len(h) == n else (None,) * 4
            assert row == want
