"""Similarity and dominance as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ruled(value: Column, na: Column, nb: Column) -> Column:
    """Two empty sets are alike, an empty and a filled one are not."""
    return F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(value)


def jaccard(c: Column, na: Column, nb: Column) -> Column:
    """Common members over all members."""
    return _ruled(c.cast("double") / F.nullif(na + nb - c, F.lit(0)), na, nb)


def cosine(c: Column, na: Column, nb: Column) -> Column:
    """Common members over the root of the sizes' product."""
    return _ruled(c / F.nullif(F.sqrt(na.cast("double") * nb.cast("double")), F.lit(0.0)), na, nb)


def overlap(c: Column, na: Column, nb: Column) -> Column:
    """Common members over the smaller size."""
    return _ruled(c.cast("double") / F.nullif(F.least(na, nb), F.lit(0)), na, nb)


MEASURES: dict[str, Callable[[Column, Column, Column], Column]] = {"jaccard": jaccard, "cosine": cosine, "overlap": overlap}


def pathsim(cross: Column, self_a: Column, self_b: Column) -> Column:
    """2 p(a,b) / (p(a,a) + p(b,b)); 1 where neither vertex has an instance to itself."""
    return F.coalesce(2.0 * cross / F.nullif(self_a + self_b, F.lit(0)), F.lit(1.0))


def dominates(a: Column, b: Column, start: int = 0, stop: int | None = None) -> Column:
    """Every component of ``a`` from ``start`` to before ``stop`` is at least that of ``b``."""
    if start or stop is not None:
        n = F.lit(stop - start) if stop is not None else F.size(a) - start
        a, b = F.slice(a, start + 1, n), F.slice(b, start + 1, n)
    return F.forall(F.zip_with(a, b, lambda x, y: x >= y), lambda x: x)


def exists_above(vectors: Column, bound: Column, start: int = 0) -> Column:
    """Some vector dominates ``bound`` from component ``start`` on."""
    return F.exists(vectors, lambda v: dominates(v, bound, start))


def vector_sum(v: Column) -> Column:
    """Sum of an array's components."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean_similarity(v: Column) -> Column:
    """Mean of a pair's similarities over the compared types: its average structural similarity."""
    return vector_sum(v) / F.size(v)


def vector_text(v: Column) -> Column:
    """Components joined by blanks."""
    return F.concat_ws(" ", F.transform(v, lambda x: x.cast("string")))


def level(s: Column) -> Column:
    """The greatest i with s >= i / 100, by comparison and not by truncating 100 s."""
    i = F.floor(s * 100).cast("int")
    return F.when(s >= (i + 1) / F.lit(100.0), i + 1).when(s < i / F.lit(100.0), i - 1).otherwise(i)
