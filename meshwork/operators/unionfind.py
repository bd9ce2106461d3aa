"""Connected components of edges that each task contracts to a spanning forest first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import connected_components

#: Edges that a task gathers before it contracts them, and vertices of a forest that it keeps.
GATHERED, KEPT = 1 << 18, 1 << 21


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the edges a - b, every node once, its root the least node that it is linked with.

    Roots with an edge to a smaller root are hung below it and paths are halved until
    all are flat, again until no edge joins two roots.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        live = p != q
        if not live.any():
            return nodes, nodes[root]
        x, y, p, q = x[live], y[live], p[live], q[live]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes = roots = np.empty(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> None:
        nonlocal nodes, roots
        nodes, roots = contract(np.concatenate([nodes, *(w[0] for w in waiting)]), np.concatenate([roots, *(w[1] for w in waiting)]))
        waiting.clear()

    def out() -> Iterator[pa.RecordBatch]:
        shared = np.isin(nodes, roots[nodes != roots])  # a root with others below it is named by them
        keep = (nodes != roots) | ~shared
        for i in range(0, len(nodes), GATHERED):
            k = keep[i : i + GATHERED]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + GATHERED][k]), pa.array(roots[i : i + GATHERED][k])], ["a", "b"])

    n = 0
    for batch in batches:
        waiting.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= GATHERED:
            fold()
            n = 0
            if len(nodes) >= KEPT:  # what is sent on may be joined later as well as here
                yield from out()
                nodes = roots = np.empty(0, np.int64)
    if waiting:
        fold()
    yield from out()


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b): a forest for each partition of ``edges`` (long ids) that links what its edges link; a lone vertex is a loop.

    No edge is shuffled. A partition sends on fewer rows than it has vertices, whatever
    the number of its edges, and holds KEPT vertices and GATHERED edges at most.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    return e.mapInArrow(_forest, "a long, b long")


def contracted_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) as :func:`connected_components` gives them, for long ids: stars join the tasks' forests."""
    return connected_components(materialize(spanning_forest(edges, a, b), "forest"))
