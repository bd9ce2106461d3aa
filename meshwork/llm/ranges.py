"""Cuts of a long column into runs of like length, for ordered passes over a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs at most: the cuts are eight bytes each on the driver and in every task. Runs that a task takes on average, which evens out their hashes.
MOST, TOGETHER = 200_000, 4


def range_cuts(docs: DataFrame, key: str, chars: int) -> tuple[int, np.ndarray]:
    """(rows, cuts): rough quantiles of ``key`` (a long without nulls) that cut ``docs`` into runs of about ``chars`` characters of text.

    Beyond MOST runs they grow longer. A run holds all rows of a key.
    """
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    runs = min(MOST, size.n, -(-size.chars // chars))
    if runs < 2:
        return size.n, np.zeros(0, np.int64)
    got = docs.agg(F.percentile_approx(key, F.lit(np.arange(1, runs) / runs), max(10_000, 4 * runs)).alias("q")).first().q
    return size.n, np.unique(np.array(got, np.int64))


def run_of(key: Column, cuts: np.ndarray) -> Column:
    """Number of the run, 0 for the least keys: of cuts below the key.

    Looked up in two steps, so a row compares about twice the square root of the
    number of cuts, and the plan holds two literals, however many there are.
    """
    if not len(cuts):
        return F.lit(0)
    block = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + block].tolist() for i in range(0, len(cuts), block)]
    heads = F.from_json(F.lit(str([b[-1] for b in blocks])), "array<bigint>")  # a block below the key counts whole
    whole = F.size(F.filter(heads, lambda c: c < key))
    fine = F.from_json(F.lit(str(blocks)), "array<array<bigint>>")
    inside = F.coalesce(F.array_size(F.filter(F.get(fine, whole), lambda c: c < key)), F.lit(0))
    return F.least(whole * block, F.lit(len(cuts))) + inside
