"""Guards against leakage and against clobbering."""

from __future__ import annotations

from pyspark.sql import DataFrame


def without_leaks(test: DataFrame, fit: DataFrame, key: str) -> DataFrame:
    """Rows of ``test`` whose key wasn't used for fitting; null keys stay, repeated rows too."""
    return test.join(fit.select(key), key, "left_anti")


def assert_disjoint(test: DataFrame, fit: DataFrame, key: str) -> None:
    """Raise if any key is in both."""
    if not test.select(key).intersect(fit.select(key)).isEmpty():
        raise ValueError(f"{key}: rows for fitting are among those for testing")
