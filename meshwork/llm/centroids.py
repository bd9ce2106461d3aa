"""Centroid clustering of integer vectors by delta Lloyd rounds.

State between rounds is a table of the vectors with owner and distance, and a table of
each cluster's sum and count. A round moves the centroids to the floored means and
compares a vector with the moved centroids alone: with its stored distance where its
owner stays, and with all centroids where its owner moved, which is what its distance
was to. Only vectors that change hands are then read again; they are added up by task
as signed transfers, out of the old cluster and into the new one, and added to the
sums. No vector is ever shuffled. On the driver are the centroids alone, k rows.

All arithmetic is exact: components are integers of at most LIMIT, distances in
doubles where these hold them exactly, else in longs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, materialize

#: Largest component of a vector, by magnitude; what lies beyond is set to it. Distances of 64 of them fit into longs.
LIMIT = 1 << 27

#: Vectors compared at a time.
STEP = 4096


def quantised(vectors: DataFrame, scale: int = 64, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, q): little-endian int32 floor(scale * x) of vectors of ``dims`` components, none null or non-finite; others are left out."""
    x = F.col(vec_col).cast("array<double>")
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == dims)
    schema = pa.schema([("vec_id", pa.int64()), ("q", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, STEP) for b in batches for i in range(0, len(b), STEP)):
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), dims)  # nulls are NaN
            keep = np.isfinite(x).all(1)
            q = np.clip(np.floor(scale * x[keep]), -LIMIT, LIMIT).astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array([v.tobytes() for v in q], pa.binary())], schema=schema)

    return whole.mapInArrow(run, "vec_id long, q binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of int rows to int centroids, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


def first_centroids(points: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The ``k`` points of least SHA-256 of ``seed:vec_id``, in this order; equal ids by their components' bytes."""
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.select(hashed.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([np.frombuffer(bytes(r.q), "<i4") for r in rows], np.int64)


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """(vec_id, q, was, owner, distance): nearest centroid of each row, of equal ones the least; ``moved``: numbers of moved centroids, None at first."""
    schema = pa.schema([("vec_id", pa.int64()), ("q", pa.binary()), ("was", pa.int32()), ("owner", pa.int32()), ("distance", pa.int64())])
    changed = np.zeros(len(centroids), bool)
    changed[slice(None) if moved is None else moved] = True
    numbers = np.flatnonzero(changed)

    def nearest(x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(x, centroids[among])
        at = d.argmin(1)
        return among[at].astype(np.int32), d[np.arange(len(d)), at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, STEP) for b in batches for i in range(0, len(b), STEP)):
            if not len(b):
                continue
            x = _matrix(b.column(1))
            if moved is None:
                was = np.full(len(b), -1, np.int32)
                owner, distance = nearest(x, numbers)
            else:
                was, distance = b.column(2).to_numpy().copy(), b.column(3).to_numpy().copy()
                owner, adrift = was.copy(), changed[was]
                if adrift.any():
                    owner[adrift], distance[adrift] = nearest(x[adrift], np.arange(len(centroids)))
                stays = np.flatnonzero(~adrift)
                if len(stays) and len(numbers):
                    other, d = nearest(x[stays], numbers)
                    closer = (d < distance[stays]) | (d == distance[stays]) & (other < owner[stays])
                    owner[stays[closer]], distance[stays[closer]] = other[closer], d[closer]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(was), pa.array(owner), pa.array(distance)], schema=schema)

    columns = ["vec_id", "q"] if moved is None else ["vec_id", "q", "owner", "distance"]
    return state.select(*columns).mapInArrow(run, "vec_id long, q binary, was int, owner int, distance long")


def _transfers(state: DataFrame) -> DataFrame:
    """(owner, n, s): by task, what clusters gain less what they lose, from the vectors that changed hands."""
    schema = pa.schema([("owner", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in (b.slice(i, STEP) for b in batches for i in range(0, len(b), STEP)):
            if not len(b):
                continue
            x = _matrix(b.column(0)).astype(np.int64)
            for sign, side in ((-1, b.column(1).to_numpy()), (1, b.column(2).to_numpy())):
                for j in np.unique(side[side >= 0]).tolist():
                    rows = x[side == j]
                    t = total.setdefault(j, [0, np.zeros(x.shape[1], np.int64)])
                    t[0] += sign * len(rows)
                    t[1] += sign * rows.sum(0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([t[1].tolist() for t in total.values()], pa.list_(pa.int64()))], schema=schema)

    return state.where("was <> owner").select("q", "was", "owner").mapInArrow(run, "owner int, n long, s array<long>")


def _added(parts: DataFrame) -> DataFrame:
    """(owner, n, s) added up by owner, component by component."""
    each = parts.select("owner", "n", F.posexplode("s").alias("at", "x")).groupBy("owner", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return each.groupBy("owner").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s")).select("owner", "n", F.col("s.x").alias("s"))


def lloyd(points: DataFrame, k: int, rounds: int, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(state, centroids): vec_id, q, owner and distance of each of ``points`` (vec_id, q) after so many rounds and a last assignment.

    A round that moves no centroid ends it early, as all later ones would do the same.
    Fewer points than ``k`` are as many centroids; none give an empty state.
    """
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.select("vec_id", "q", F.lit(0).alias("owner"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    state = materialize(_assigned(points, centroids, None), "owners")
    sums = materialize(_added(_transfers(state)), "sums", 1)
    for _ in range(rounds):
        after = centroids.copy()
        for r in sums.where("n > 0").collect():  # k rows at most
            after[r.owner] = [x // r.n for x in r.s]
        moved = np.flatnonzero((after != centroids).any(1))
        centroids = after
        if not len(moved):
            break
        new = materialize(_assigned(state, centroids, moved), "owners")
        drop_table(state)
        state = new
        changed = materialize(_added(sums.unionByName(_transfers(state))), "sums", 1)
        drop_table(sums)
        sums = changed
    return state.select("vec_id", "q", "owner", "distance"), centroids


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1) -> DataFrame:
    """One row for each vector of exactly ``dims`` components, none null or non-finite.

    vec_id, cluster, distance (squared), cluster_inertia, inertia (sums of distances
    over the cluster and over all, 2^63 - 1 at most) and centroid_sha256 (of the
    cluster's final centroid, components in decimal joined by commas). Components are
    floor(scale * x), within LIMIT. Rows that share an id are vectors of their own, a
    null id hashes as an empty one; of equally near centroids the least number owns a
    vector; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    points = materialize(quantised(vectors, scale, dims), "points")
    state, centroids = lloyd(points, k, rounds, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    named = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    each = materialize(state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")), "inertia", 1)
    whole = F.broadcast(each.agg(F.least(F.sum("d"), most).cast("long").alias("inertia")))
    each = each.select("owner", F.least("d", most).cast("long").alias("cluster_inertia")).join(F.broadcast(spark.createDataFrame(named, "owner int, centroid_sha256 string")), "owner").crossJoin(whole)
    return state.join(F.broadcast(each), "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
