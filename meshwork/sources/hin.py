"""Heterogeneous information networks as two DataFrames, their sources and sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

VERTICES = "id long, source_id long, type int"
EDGES = "src long, src_type int, dst long, dst_type int, edge_type int"


def dense_index(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with 0, 1, 2 ... in the order of ``keys``, counted by sorted partition, never in one task."""
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialize(rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "indexed")
    counts = {r["_p"]: r["n"] for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row per partition
    at, starts = 0, []
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    base = df.sparkSession.createDataFrame(starts, "_p int, _b long")
    return rows.join(F.broadcast(base), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


@dataclass(frozen=True)
class Hin:
    """vertices (id, source_id, type) and directed edges (src, src_type, dst, dst_type, edge_type), parallel ones kept."""

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def from_tables(cls, vertices: DataFrame, edges: DataFrame, symmetric: bool = True) -> Hin:
        """Renumber (source_id, type) and (src, dst, edge_type) given in source ids.

        New ids and types are dense: types ascending, source ids ascending within a
        type. An edge to an unknown vertex is an error. With ``symmetric`` every edge
        must also be listed from its other end.
        """
        spark = vertices.sparkSession
        kinds = sorted(r[0] for r in vertices.select("type").distinct().collect())
        types = spark.createDataFrame([(t, i) for i, t in enumerate(kinds)], "type int, new_type int")
        v = dense_index(vertices.select("source_id", "type"), ["type", "source_id"], "id").join(F.broadcast(types), "type").select("id", "source_id", F.col("new_type").alias("type"))
        v = materialize(v, "vertices")
        e = edges.select("src", "dst", F.col("edge_type").cast("int").alias("edge_type"))
        for side in ("src", "dst"):
            new = v.select(F.col("source_id").alias(side), F.col("id").alias(f"n_{side}"), F.col("type").alias(f"{side}_type"))
            e = e.join(new, side, "left")
        e = materialize(e.select(F.col("n_src").alias("src"), "src_type", F.col("n_dst").alias("dst"), "dst_type", "edge_type"), "edges")
        if not e.where("src is null or dst is null").isEmpty():
            raise ValueError("an edge ends at an unknown vertex")
        hin = cls(v, e)
        if symmetric and not hin.one_sided().isEmpty():
            raise ValueError("an edge is listed from one end only")
        return hin

    @classmethod
    def from_files(cls, spark: SparkSession, folder: str, symmetric: bool = True) -> Hin:
        """Read vertex.txt (id type), edge.txt (edge_id type) and graph.txt (src (neighbour edge_id)*)."""
        words = lambda name: spark.read.text(f"{folder}/{name}").select(F.split(F.trim("value"), r"\s+").cast("array<long>").alias("x")).where(F.size("x") > 0)
        vertices = words("vertex.txt").select(F.col("x")[0].alias("source_id"), F.col("x")[1].cast("int").alias("type"))
        kinds = words("edge.txt").select(F.col("x")[0].alias("edge_id"), F.col("x")[1].cast("int").alias("edge_type"))
        n, ids, low, high = kinds.agg(F.count("*"), F.countDistinct("edge_id"), F.min("edge_id"), F.max("edge_id")).first()
        if n and (ids, low, high) != (n, 0, n - 1):
            raise ValueError("edge ids are not 0, 1, 2 ...")
        rows = words("graph.txt").select(F.col("x")[0].alias("src"), F.slice("x", 2, F.size("x")).alias("x"))
        pairs = F.when(F.size("x") > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda i: F.struct(F.get("x", 2 * i).alias("dst"), F.get("x", 2 * i + 1).alias("edge_id"))))
        listed = rows.select("src", F.explode(pairs).alias("p")).select("src", "p.dst", "p.edge_id")
        joined = listed.join(kinds, "edge_id", "left")
        if not joined.where("edge_type is null").isEmpty():
            raise ValueError("an adjacency names an unknown edge")
        return cls.from_tables(vertices, joined.select("src", "dst", "edge_type"), symmetric)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Hin:
        """Read what :meth:`save` wrote."""
        edges = spark.read.parquet(f"{folder}/edges")
        return cls(spark.read.parquet(f"{folder}/vertices"), edges.select("src", "src_type", "dst", "dst_type", "edge_type"))

    def save(self, folder: str) -> None:
        """Write both tables as Parquet, edges partitioned by the types of both ends, so that a path reads its own types only."""
        self.vertices.write.mode("overwrite").parquet(f"{folder}/vertices")
        self.edges.write.mode("overwrite").partitionBy("src_type", "dst_type").parquet(f"{folder}/edges")

    def export_text(self, folder: str) -> None:
        """Write vertex_map, graph_type, graph_offset and graph_info as text: adjacency in CSR order."""
        e = dense_index(self.edges, ["src", "dst_type", "dst", "edge_type"], "at")
        put = lambda df, cols, name, keys: df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.concat_ws(" ", *cols)).write.mode("overwrite").text(f"{folder}/{name}")
        put(self.vertices, ["id", "source_id", "type"], "vertex_map", ["id"])
        put(e, ["dst", "dst_type", "edge_type"], "graph_type", ["at"])
        out = self.edges.groupBy("src").agg(F.count("*").alias("n")).withColumnRenamed("src", "id")
        degrees = dense_index(self.vertices.join(out, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")), ["id"], "row")
        first = e.groupBy("src").agg(F.min("at").alias("offset")).withColumnRenamed("src", "id")
        # a vertex without edges starts where the next one with edges does
        put(degrees.join(first, "id", "left").select("id", "n", F.coalesce("offset", F.lit(-1)).alias("offset")), ["id", "n", "offset"], "graph_offset", ["id"])
        counts = self.schema()
        lines = [f"{self.edges.count()} {self.vertices.count()} {self.vertices.select('type').distinct().count()}"]
        lines += [f"{r.type} {r.start}" for r in self.vertices.groupBy("type").agg(F.min("id").alias("start")).orderBy("type").collect()]
        lines += [f"{r.src_type} {r.dst_type} {r.cnt}" for r in counts.orderBy("src_type", "dst_type").collect()]
        self.vertices.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/graph_info")

    def one_sided(self) -> DataFrame:
        """(src, dst) pairs without a pair from the other end: one grouped pass, combined before the shuffle."""
        ends = self.edges.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.max(F.col("src") <= F.col("dst")).alias("up"), F.max(F.col("src") >= F.col("dst")).alias("down"))
        return ends.where(~(F.col("up") & F.col("down"))).select(F.when(F.col("up"), F.col("lo")).otherwise(F.col("hi")).alias("src"), F.when(F.col("up"), F.col("hi")).otherwise(F.col("lo")).alias("dst"))

    def schema(self) -> DataFrame:
        """src_type, dst_type, cnt: directed edges between types."""
        return self.edges.groupBy("src_type", "dst_type").agg(F.count("*").alias("cnt"))

    def type_graph(self) -> DataFrame:
        """src_type, dst_type: types that are adjacent, in both directions."""
        s = self.schema().select("src_type", "dst_type")
        return s.union(s.select("dst_type", "src_type")).distinct()

    def of_type(self, kind: int) -> DataFrame:
        """Vertices of one type."""
        return self.vertices.where(F.col("type") == kind)


def write_communities(output: DataFrame, path: str) -> None:
    """Write (v, role, cid) as text: c core, n non-core member, h hub, o outlier; cid -1 for h and o."""
    output.select(F.concat_ws(" ", "v", "role", "cid")).write.mode("overwrite").text(path)


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """Read what :func:`write_communities` wrote."""
    return spark.read.csv(path, sep=" ", schema="v long, role string, cid long")


def as_evaluation(output: DataFrame) -> DataFrame:
    """(id, cluster_id) pairs for the F1 scores: hubs and outliers become ``o``."""
    return output.select(F.col("v").alias("id"), F.when(F.col("cid") < 0, F.lit("o")).otherwise(F.col("cid").cast("string")).alias("cluster_id"))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """(id, cluster_id) from a text file of two columns."""
    return spark.read.csv(path, sep=" ", schema="id long, cluster_id string")


def write_projection(projected: DataFrame, folder: str) -> None:
    """Write a homogeneous projection (u, w) as adj (u and its sorted neighbours) and degree (u, n)."""
    adj = projected.groupBy("u").agg(F.array_sort(F.collect_set("w")).alias("ws"))
    adj.select(F.concat_ws(" ", "u", F.concat_ws(" ", F.col("ws").cast("array<string>")))).write.mode("overwrite").text(f"{folder}/adj")
    adj.select(F.concat_ws(" ", "u", F.size("ws").cast("string"))).write.mode("overwrite").text(f"{folder}/degree")


def read_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    """(u, w) of a projection's adj."""
    x = spark.read.text(f"{folder}/adj").select(F.split("value", " ").cast("array<long>").alias("x"))
    return x.select(F.col("x")[0].alias("u"), F.explode(F.slice("x", 2, F.size("x"))).alias("w"))


def read_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """(u, n) of a projection's degree."""
    return spark.read.csv(f"{folder}/degree", sep=" ", schema="u long, n long")


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """A tab-separated attribute table (authors, venues, topics) with a given schema."""
    return spark.read.csv(path, sep="\t", schema=schema, header=header)


def write_labels(labels: DataFrame, path: str) -> None:
    """Write (id, label), blank-separated, without header."""
    labels.select("id", "label").write.mode("overwrite").csv(path, sep=" ", header=False)
