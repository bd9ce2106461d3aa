"""Document fingerprints: one-permutation MinHash, optimally densified, in packed low bits.

Each shingle of five words is hashed once. The high bits choose one of BINS bins,
which keeps its least hash. An empty bin borrows from the bin that a 2-universal
sequence of (bin, attempt) first finds filled, the same for every document. Four
low-order bits of each bin's hash are stored. Equal bits by chance are taken out
of the likeness: (m - c) / (1 - c) with c = 2**-4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .ranges import TOGETHER, range_cuts, run_of
from .text import ROWS, small_batches, words

SHINGLE, BITS = 5, 4
BIN_BITS = 9
BINS = 1 << BIN_BITS

#: Words whose hashes a worker remembers before it starts anew.
MEMORY = 400_000

#: Characters of text in a run of ids.
RUN_CHARS = 4 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _attempts(first: int, last: int) -> np.ndarray:
    """Bin that each bin tries in attempts first..last-1: one row per attempt."""
    t = np.arange(first, last, dtype=np.uint64)[:, None]
    b = np.arange(BINS, dtype=np.uint64)[None, :]
    return (_mix((t << np.uint64(BIN_BITS)) + b + np.uint64(1)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


_TRIES = [(_attempts(0, 8)), (_attempts(8, 72)), (_attempts(72, 1096))]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingle_hashes(ws: list[bytes]) -> np.ndarray:
    """One hash per shingle; of fewer than five words the whole sequence; of none nothing."""
    if len(_hashes) > MEMORY:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))
    k = min(SHINGLE, len(ws))
    if not k:
        return h
    n = len(ws) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out + _mix(h[i : i + n] ^ _ODD[i]) * _ODD[(i + 1) % 5]
    return _mix(out)


def fingerprint(ws: list[bytes]) -> np.ndarray | None:
    """BINS values of BITS bits; None without words."""
    h = shingle_hashes(ws)
    if not len(h):
        return None
    h.sort()
    where = (h >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.r_[True, where[1:] != where[:-1]]
    values, filled = np.zeros(BINS, np.uint8), np.zeros(BINS, bool)
    filled[where[first]] = True
    values[where[first]] = (h[first] & np.uint64(2**BITS - 1)).astype(np.uint8)
    empty = np.flatnonzero(~filled)
    if len(empty) == BINS - 1:
        values[:] = values[where[0]]
        return values
    source = np.full(BINS, -1)
    for tries in _TRIES:
        if not len(empty):
            break
        to = tries[:, empty]
        ok = filled[to]
        got = ok.any(axis=0)
        source[empty[got]] = to[ok.argmax(axis=0)[got], np.flatnonzero(got)]
        empty = empty[~got]
    source[empty] = where[0]  # after all attempts
    borrowed = source >= 0
    values[borrowed] = values[source[borrowed]]
    return values


def packed(values: np.ndarray | None) -> str:
    """Two bins a byte, in hexadecimal digits; empty without words."""
    return "" if values is None else ((values[0::2] << 4) | values[1::2]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity, 0 to 1; two documents without words are alike, one without is unlike any other."""
    if a is None or b is None:
        return float(a is b)
    chance = 2.0**-BITS
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def _marked(docs: DataFrame, run_chars: int) -> tuple[DataFrame, int]:
    """(bucket, doc_id, text, extra): runs of descending ids; each run also has, as an extra row, what follows its last."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    _, cuts = range_cuts(docs.withColumn("key", key), "key", run_chars)
    place = F.lit(len(cuts)) - run_of(key, cuts)  # descending: bucket 0 has the largest ids
    tops = docs.select(place.alias("bucket"), key.alias("k")).groupBy("bucket").agg(F.max("k").alias("top")).orderBy("bucket").collect()  # a row per run
    first = {r.top: tops[i - 1].bucket for i, r in enumerate(tops)}  # the head of a run ends the run before; the very first ends the last
    heads = docs.sparkSession.createDataFrame([(k, b) for k, b in first.items()], "head long, also int")
    plain = docs.select(place.cast("int").alias("bucket"), "doc_id", "text", F.lit(0).alias("extra"))
    after = docs.join(broadcast_if_small(heads), key == F.col("head")).groupBy("also").agg(F.max(F.struct(key.alias("k"), "text", "doc_id")).alias("x"))
    return plain.unionByName(after.select(F.col("also").alias("bucket"), "x.doc_id", "x.text", F.lit(1).alias("extra"))), max(1, len(tops))


def fingerprint_neighbours(docs: DataFrame, run_chars: int = RUN_CHARS) -> DataFrame:
    """Fingerprints of each document and of its edited text, and what they tell of their likeness.

    The edited text has the last floor(n/2) code points replaced by the first as
    many, or all, of the next document in descending order of doc_id; after the
    last comes the first. Ids that repeat are ordered by descending text, a null
    doc_id is last. One row per input row. A null text is empty; texts without
    words have the empty fingerprint; an only document is its own next; an empty
    table gives an empty result; other columns are ignored.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    small_batches(docs.sparkSession)
    rows, buckets = _marked(docs, run_chars)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            out = []
            for bucket, doc, text, extra in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "extra")), strict=True):
                print_ = fingerprint(words(text))
                if held and held[0] == bucket:
                    _, was, old, before = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    new = fingerprint(words(edited))
                    out.append((was, len(old), hashlib.sha256(edited.encode("utf-8")).hexdigest(), packed(before), packed(new), likeness(before, new), likeness(before, print_)))
                held = None if extra else (bucket, doc, text, print_)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 7, arrow, strict=True)], schema=arrow)

    key = F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))
    ordered = rows.repartition(-(-buckets // TOGETHER), "bucket").sortWithinPartitions("bucket", "extra", key.desc(), F.col("text").desc())
    return ordered.mapInArrow(run, schema)
