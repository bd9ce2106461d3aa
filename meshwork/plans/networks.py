"""Networks over relational tables: neighbourhoods nbr (u, type, v), and a full network."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_table, shared_dir
from ..sources.hin import Hin

CUSTOMER, ORDER, PART, SUPPLIER, NATION, REGION = range(6)

#: Source ids of a full network: type * BASE + key.
BASE = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nbr(*parts: tuple[DataFrame, str, int, str]) -> DataFrame:
    """Distinct (u, type, v) of (frame, column of u, type, column of v), dealt by u, as grouping by it asks for."""
    rows = [df.select(F.col(u).cast("long").alias("u"), F.lit(t).alias("type"), F.col(v).cast("string").alias("v")).where("u is not null and v is not null") for df, u, t, v in parts]
    return reduce(lambda a, b: a.unionByName(b), rows).repartition("u").distinct()


def part_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by their type (1) and suppliers (2)."""
    return _nbr((table(spark, sf_dir, "part"), "p_partkey", 1, "p_type"), (table(spark, sf_dir, "lineitem"), "l_partkey", 2, "l_suppkey"))


def customer_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by their nation (1) and the suppliers of their orders (2)."""
    c, o, li = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    return _nbr((c, "c_custkey", 1, "c_nationkey"), (o.join(li, o.o_orderkey == li.l_orderkey), "o_custkey", 2, "l_suppkey"))


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation (1), the priorities (2), suppliers (3) and states (4) of their orders, and nation with segment (5)."""
    c, o, li = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    market = c.select("c_custkey", F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("market"))
    orders = [(o, "o_custkey", 2, "o_orderpriority"), (o.join(li, o.o_orderkey == li.l_orderkey), "o_custkey", 3, "l_suppkey"), (o, "o_custkey", 4, "o_orderstatus")]
    return _nbr((c, "c_custkey", 1, "c_nationkey"), *orders, (market, "c_custkey", 5, "market"))


def part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand (1) and the words of their names (2)."""
    p = table(spark, sf_dir, "part")
    return _nbr((p, "p_partkey", 1, "p_brand"), (p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")), "p_partkey", 2, "word"))


def order_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer (1) and suppliers (2); some orders have none."""
    return _nbr((table(spark, sf_dir, "orders"), "o_orderkey", 1, "o_custkey"), (table(spark, sf_dir, "lineitem"), "l_orderkey", 2, "l_suppkey"))


def vertices_of(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """(u) of a table's keys."""
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias("u")).distinct()


def raw_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (source_id, type) and edges (src, dst, edge_type) of all six types, edges from both ends."""
    c, o, p, s, n, r, li = (table(spark, sf_dir, x) for x in ("customer", "orders", "part", "supplier", "nation", "region", "lineitem"))
    kinds = [(c, "c_custkey"), (o, "o_orderkey"), (p, "p_partkey"), (s, "s_suppkey"), (n, "n_nationkey"), (r, "r_regionkey")]
    node = lambda t, k: F.col(k).cast("long") + F.lit(t * BASE)
    vertices = reduce(lambda a, b: a.unionByName(b), [df.select(node(t, k).alias("source_id"), F.lit(t).alias("type")) for t, (df, k) in enumerate(kinds)])
    links = [
        (o, CUSTOMER, "o_custkey", ORDER, "o_orderkey"), (li, ORDER, "l_orderkey", PART, "l_partkey"), (li, ORDER, "l_orderkey", SUPPLIER, "l_suppkey"),
        (c, CUSTOMER, "c_custkey", NATION, "c_nationkey"), (s, SUPPLIER, "s_suppkey", NATION, "s_nationkey"), (n, NATION, "n_nationkey", REGION, "n_regionkey"),
    ]
    edges = []
    for i, (df, ta, a, tb, b) in enumerate(links):
        edges.append(df.select(node(ta, a).alias("src"), node(tb, b).alias("dst"), F.lit(2 * i).alias("edge_type")))
        edges.append(df.select(node(tb, b).alias("src"), node(ta, a).alias("dst"), F.lit(2 * i + 1).alias("edge_type")))
    return vertices, reduce(lambda a, b: a.unionByName(b), edges)


#: Folder of each network that this session has stored, by application and tables.
_STORED: dict[tuple[str, str], str] = {}


def network(spark: SparkSession, sf_dir: str) -> Hin:
    """The full network: renumbered and stored in the shared folder when first asked for, then loaded from there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        folder = f"{shared_dir(spark)}/meshwork/network-{uuid.uuid4().hex}"
        hin = Hin.from_tables(*raw_network(spark, sf_dir))
        hin.save(folder)
        drop_table(hin.edges)
        _STORED[key] = folder
    return Hin.load(spark, _STORED[key])
