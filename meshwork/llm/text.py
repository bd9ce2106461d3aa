"""Shared text rules of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that one step of a Python worker holds at most, besides a single longer text.
STEP_CHARS = 500_000

#: Rows that one step holds at most.
STEP_ROWS = 250

#: Rows and bytes of a batch between Spark and its Python workers, at most: texts are long, and batches lie outside the heap.
ROWS, BATCH_BYTES = 250, 1 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of batches to those above; smaller ones stay."""
    for key, most in _BATCHES.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` has it in either case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: str | None) -> list[bytes]:
    """Words of ``text`` as UTF-8, A-Z in lower case; None has none.

    ``bytes.lower`` and ``bytes.split`` know ASCII alone, which is exactly the rule.
    """
    return text.encode("utf-8").lower().split() if text else []


def steps(texts: list[str]) -> Iterator[slice]:
    """Slices of ``texts`` with about STEP_CHARS characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def gathered(parts: Iterator[tuple[list, list[str]]], chars: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of parts, put together until they have ``chars`` characters; all of the last ones."""
    ids, texts, size = [], [], 0
    for i, t in parts:
        ids, texts, size = ids + i, texts + t, size + sum(map(len, t))
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list, list[str]], dict[str, list]]], schema: str, together: int = 0) -> DataFrame:
    """Rows for (doc_id, text) pairs, in Arrow batches; a null text counts as empty.

    ``make`` runs once in each task and returns the function from ids and texts
    to columns; it gets a step of a batch, or ``together`` characters of several
    steps. Other columns of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, f = to_arrow_schema(spec), make()
        cut = ((b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]) for b in (b.slice(i, STEP_ROWS) for b in batches for i in range(0, len(b), STEP_ROWS)))
        parts = ((ids[s], texts[s]) for ids, texts in cut for s in steps(texts))
        for ids, texts in gathered(parts, together) if together else parts:
            out = f(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(out[c.name], c.type) for c in arrow], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, spec)
