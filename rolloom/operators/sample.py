"""Bounded samples for the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest(rows: DataFrame, hashed: Column, n: int, total: int, *then: str) -> DataFrame:
    """The `n` rows with the smallest 64-bit hash, then in the order of `then`.

    Each task of a top-k sends `n` rows to the driver, so rows that can't be among them are left out before: with about `total` rows, the smallest `n` hashes lie within
    the first 2 n / total of all hashes (fewer than `n` of 2 n expected rows there has a probability below e^(-n / 4)).
    """
    if total > 4 * n:
        rows = rows.where(hashed < F.lit(-(1 << 63) + int((1 << 64) * (2 * n / total))))
    return rows.orderBy(hashed, *then).limit(n)
