"""Operators of a training-data pipeline: text quality, language, toxicity, near copies, mixing, tokens, archives, search.

Nothing else in the library imports this subpackage.
"""
