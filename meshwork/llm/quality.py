"""Quality classifier: Bradley-Terry scores from preference pairs, cut at a score quantile.

Documents are described by measures of their bytes, words and lines. Each measure
is turned into soft indicators of its quantile bands over the training sample.
A linear score is learned from pairs (a label-1 document, a label-0 document): the
first is preferred with probability sigmoid(score difference), so the loss is
logistic on feature differences, minimised by Newton steps. The cut is the
training scores' quantile at the share of label 0; scores are mapped by a
logistic curve that puts the cut at CUT.

Only the fit uses a bounded sample: at most ``sample`` labelled rows, those whose
ids have the smallest hashes, and all their pairs, or ``pairs`` drawn at random where
there are more. Every document is scored from its whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ROWS, map_texts, small_batches

#: Labelled rows and preference pairs of a fit, bands of a measure, score of the cut.
SAMPLE, PAIRS, BANDS, CUT = 20_000, 120_000, 8, 0.3

_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,), "stop": b".", "comma": b",", "shout": b"!?",
    "bar": b"|", "mark": b"*#$%&@^~", "bracket": b"()[]{}<>", "slash": b"/\\_=+-:;", "quote": b"\"'`", "control": (*range(0, 9), *range(14, 32), 127), "high": range(128, 256),
}
_TABLE = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS.values()):
    _TABLE[list(_g), _i] = 1
MEASURES = len(_GROUPS) + 11


def measures(text: str) -> list[float]:
    """Numbers that describe a whole text; an empty text has zeros."""
    raw = text.encode("utf-8")
    if not raw:
        return [0.0] * MEASURES
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = counts[counts > 0] / len(raw)
    shares = counts @ _TABLE / len(raw)
    ws = raw.lower().split()
    n = max(1, len(ws))
    lines = raw.split(b"\n")
    kinds = len(set(ws))
    half = ws[: len(ws) // 2]
    return [
        *shares.tolist(), math.log1p(len(raw)), math.log1p(len(ws)), float(-(p * np.log2(p)).sum()), sum(map(len, ws)) / n, max(map(len, ws), default=0) ** 0.5,
        kinds / n, kinds / n**0.75, sum(map(eq, ws, ws[1:])) / n, len(set(half)) / max(1, len(half)), len(set(lines)) / len(lines), math.log1p(n / len(lines)),
    ]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text modulo ``folds`` is ``fold``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


@dataclass(frozen=True)
class Model:
    """Edges of the bands, weights of the indicators, the cut and the slope at it."""

    edges: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def indicators(self, x: np.ndarray) -> np.ndarray:
        """Piecewise linear position of each measure in each of its bands, 0 to 1."""
        low, high = self.edges[:, :-1], self.edges[:, 1:]
        width = np.where(high > low, high - low, 1.0)
        t = np.clip((x[:, :, None] - low) / width, 0, 1)
        return np.where(high > low, t, x[:, :, None] > low).reshape(len(x), -1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.indicators(x) @ self.weights if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; at least CUT exactly where the raw score is at least the cut."""
        z = np.clip((self.raw(x) - self.cut) * self.slope, -30, 30)
        s = 1 / (1 + np.exp(-(z + math.log(CUT / (1 - CUT)))))
        return np.where(z >= 0, np.maximum(s, CUT), np.minimum(s, np.nextafter(CUT, 0)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11, pairs: int = PAIRS) -> Model:
    """A model of ``y`` (0/1) by measures ``x``. With one label only every text gets that label."""
    y = y.astype(bool)
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros((MEASURES, 2)), np.zeros(MEASURES), -1.0 if not len(y) or y.all() else 1.0, 1.0)
    edges = np.quantile(x, np.linspace(0, 1, BANDS + 1), axis=0).T
    model = Model(edges, np.zeros(MEASURES * BANDS), 0.0, 1.0)
    f = model.indicators(x)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y), np.flatnonzero(~y)
    first, second = (rng.choice(good, pairs), rng.choice(bad, pairs)) if len(good) * len(bad) > pairs else (np.repeat(good, len(bad)), np.tile(bad, len(good)))
    w, ridge = np.zeros(f.shape[1]), 2e-3 * len(first)
    for _ in range(12):
        curve, slope = np.eye(len(w)) * ridge, -ridge * w
        for i in range(0, len(first), 4096):  # the pairs' differences are never held all at once
            d = f[first[i : i + 4096]] - f[second[i : i + 4096]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            curve += (d * (p * (1 - p))[:, None]).T @ d
            slope += d.T @ (1 - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = f @ w
    return Model(edges, w, float(np.quantile(s, 1 - y.mean())), 1.0)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE, pairs: int = PAIRS) -> Model:
    """Fit on labelled documents outside the held-out fold; rows without a quality of 0 or 1 are no labels."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    quality = {r.doc_id: r.quality for r in rows}
    if not quality:
        return fit(np.zeros((0, MEASURES)), np.zeros(0))
    chosen = docs.sparkSession.createDataFrame([(k,) for k in quality], "doc_id long")
    some = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(chosen), "doc_id", "left_semi")

    def make():
        return lambda ids, texts: {"doc_id": ids, "x": [measures(t) for t in texts]}

    got = sorted((r.doc_id, r.x) for r in map_texts(some, make, "doc_id long, x array<double>").collect())
    return fit(np.array([x for _, x in got]).reshape(-1, MEASURES), np.array([quality[d] for d, _ in got]), pairs=pairs)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE, pairs: int = PAIRS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= CUT) of every row.

    Scores depend on the text alone; null and empty texts are scored as the empty
    text. Without labels every text gets label 1. Repeated rows are scored alike;
    an empty table gives an empty result; other columns are ignored.
    """
    model = learn(docs, labels, folds, fold, sample, pairs)

    def make():
        def run(ids, texts):
            s = model.score(np.array([measures(t) for t in texts]).reshape(-1, MEASURES))
            return {"doc_id": ids, "score": s.tolist(), "predicted": (s >= CUT).astype(np.int32).tolist()}

        return run

    got = map_texts(docs, make, "doc_id long, score double, predicted int")
    return got.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE, pairs: int = PAIRS) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, as they are.

    A null text is judged as the empty one; null and repeated ids, extra columns and
    empty tables pass through, since a row is judged by its text alone.
    """
    model = learn(docs, labels, folds, fold, sample, pairs)
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            texts = [str(t) if t else "" for t in b.column(at).to_pylist()]
            x = np.array([measures(t) for t in texts]).reshape(-1, MEASURES)
            yield b.filter(pa.array(model.score(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)
