"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions.levels import bits_levels, bits_size
from ..functions.similarity import MEASURES, level, mean_similarity
from ..operators import bounds, community, components, forest, index, labels, metapath, metrics, neighborhood, seeded, similarity, skyline, unionfind
from ..operators.diameter import exact_diameter, induced, linked
from ..session import materialize, shared_dir
from ..sources.hin import as_evaluation
from ..sources.spec import MetaPath, parse_spec
from . import networks as N

Query = Callable[[SparkSession, str], DataFrame]

EPS, MU = {1: 0.3, 2: 0.3}, 5
S_N_S, S_O_S = MetaPath((N.SUPPLIER, N.NATION, N.SUPPLIER), (-1, -1)), MetaPath((N.SUPPLIER, N.ORDER, N.SUPPLIER), (-1, -1))
S_O_C_O_S = MetaPath((N.SUPPLIER, N.ORDER, N.CUSTOMER, N.ORDER, N.SUPPLIER), (-1, -1, -1, -1))
C_O_P_O_C = MetaPath((N.CUSTOMER, N.ORDER, N.PART, N.ORDER, N.CUSTOMER), (-1, -1, -1, -1))

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- SQL shared by several queries -------------------------------------------

_B = N.BASE
_H1 = "nbr AS (SELECT p_partkey AS u, 1 AS type, p_type AS v FROM part UNION SELECT l_partkey, 2, CAST(l_suppkey AS VARCHAR) FROM lineitem)"
_H2 = """nbr AS (SELECT c_custkey AS u, 1 AS type, CAST(c_nationkey AS VARCHAR) AS v FROM customer UNION SELECT o_custkey, 2, CAST(l_suppkey AS
  VARCHAR) FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
_H3 = "nbr AS (SELECT p_partkey AS u, 1 AS type, p_brand AS v FROM part UNION SELECT p_partkey, 2, unnest(string_split(p_name, ' ')) FROM part)"
_H4 = """nbr AS (SELECT o_orderkey AS u, 1 AS type, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION SELECT l_orderkey, 2, CAST(l_suppkey AS
  VARCHAR) FROM lineitem)"""
_SIM = """n AS (SELECT u, type, count(*) AS n FROM nbr GROUP BY u, type),
c AS (SELECT a.u, b.u AS w, a.type, count(*) AS c FROM nbr a JOIN nbr b ON a.type = b.type AND a.v = b.v GROUP BY a.u, b.u, a.type),
sim AS (SELECT c.u, c.w, c.type, c.c::DOUBLE / (x.n + y.n - c.c) AS s, c.c, x.n AS na, y.n AS nb FROM c JOIN n x ON c.u = x.u AND c.type = x.type JOIN n y ON c.w = y.u AND c.type = y.type)"""
_EDGES = "edges AS (SELECT u, w FROM sim WHERE s >= 0.3::DOUBLE GROUP BY u, w HAVING count(*) = 2)"


def _scan(mu: int) -> str:
    return f"""cores AS (SELECT u FROM edges GROUP BY u HAVING count(*) >= {mu}),
cc AS (SELECT e.u, e.w FROM edges e JOIN cores a ON e.u = a.u JOIN cores b ON e.w = b.u),
reach AS (SELECT u, u AS w FROM cores UNION SELECT r.u, c.w FROM reach r JOIN cc c ON r.w = c.u),
clusters AS (SELECT u, min(w) AS cid FROM reach GROUP BY u),
members AS (SELECT u AS v, cid, 'c' AS role FROM clusters UNION ALL
  SELECT DISTINCT e.w, k.cid, 'n' FROM edges e JOIN clusters k ON e.u = k.u WHERE e.w NOT IN (SELECT u FROM cores))"""


_H1_SCAN = f"WITH RECURSIVE {_H1}, {_SIM}, {_EDGES}, {_scan(MU)}"
_ROLES = """others AS (SELECT p.p_partkey AS v FROM part p WHERE p.p_partkey NOT IN (SELECT v FROM members)),
near AS (SELECT a.u, a.w FROM sim a JOIN sim b ON a.u = b.u AND a.w = b.w WHERE a.type = 1 AND b.type = 2),
hubs AS (SELECT o.v FROM others o JOIN near x ON x.u = o.v JOIN members m ON m.v = x.w GROUP BY o.v HAVING count(DISTINCT m.cid) > 1),
output AS (SELECT v, role, cid FROM members UNION ALL SELECT v, CASE WHEN v IN (SELECT v FROM hubs) THEN 'h' ELSE 'o' END, -1 FROM others)"""
_EDGES6 = [("orders", 0, "o_custkey", 1, "o_orderkey"), ("lineitem", 1, "l_orderkey", 2, "l_partkey"), ("lineitem", 1, "l_orderkey", 3, "l_suppkey"), ("customer", 0, "c_custkey", 4, "c_nationkey"), ("supplier", 3, "s_suppkey", 4, "s_nationkey"), ("nation", 4, "n_nationkey", 5, "n_regionkey")]
_NODES6 = [("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")]
_HIN = (
    "raw AS ("
    + " UNION ALL ".join(f"SELECT {k}::BIGINT + {t * _B} AS source_id, {t} AS type FROM {n}" for t, (n, k) in enumerate(_NODES6))
    + "), vertices AS (SELECT row_number() OVER (ORDER BY type, source_id) - 1 AS id, source_id, type FROM raw), listed AS ("
    + " UNION ALL ".join(f"SELECT {a}::BIGINT + {ta * _B} AS src, {b}::BIGINT + {tb * _B} AS dst, {2 * i} AS edge_type FROM {n} UNION ALL SELECT {b}::BIGINT + {tb * _B}, {a}::BIGINT + {ta * _B}, {2 * i + 1} FROM {n}" for i, (n, ta, a, tb, b) in enumerate(_EDGES6))
    + "), edges6 AS (SELECT x.id AS src, x.type AS src_type, y.id AS dst, y.type AS dst_type, edge_type FROM listed JOIN vertices x ON src = x.source_id JOIN vertices y ON dst = y.source_id)"
)


# -- the full network ----------------------------------------------------------


@query(f"WITH {_HIN} SELECT id, source_id, type FROM vertices")
def hin_vertices(spark, d):
    """Renumbered vertices."""
    return N.network(spark, d).vertices


@query(f"WITH {_HIN} SELECT src, src_type, dst, dst_type, edge_type FROM edges6")
def hin_edges(spark, d):
    """Renumbered edges, parallel ones kept."""
    return N.network(spark, d).edges


@query(f"WITH {_HIN} SELECT src_type, dst_type, count(*) AS cnt FROM edges6 GROUP BY ALL")
def hin_schema(spark, d):
    """Edges between types."""
    return N.network(spark, d).schema()


@query(f"""WITH RECURSIVE {_HIN},
t AS (SELECT DISTINCT src_type, dst_type FROM edges6),
walk AS (SELECT 0 AS type, 0 AS distance UNION SELECT t.dst_type, distance + 1 FROM walk JOIN t ON walk.type = t.src_type WHERE distance <
  5)
SELECT type, min(distance) AS distance FROM walk GROUP BY type""")
def schema_distance(spark, d):
    """Hops between types, from customers."""
    found = neighborhood.schema_distance(N.network(spark, d), N.CUSTOMER)
    return spark.createDataFrame(sorted(found.items()), "type int, distance int")


@query(f"""WITH {_HIN},
q AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS local_id, count(*) OVER () AS n FROM vertices WHERE type = 0)
SELECT id FROM q WHERE local_id >= 1 AND (local_id - 1) % (n // 20) = 0 AND local_id < 1 + 20 * (n // 20)""")
def stride_sample(spark, d):
    """Twenty customers at even strides."""
    hin = N.network(spark, d)
    own = hin.of_type(N.CUSTOMER)
    n, low = own.agg(F.count("*"), F.min("id")).first()
    return neighborhood.stride_sample(own.withColumn("local_id", F.col("id") - low), n, 20).select("id")


@query(f"""WITH {_HIN}
SELECT DISTINCT src AS u, dst_type AS type, dst AS v FROM edges6 WHERE src_type = 1 UNION SELECT id, type, id FROM vertices WHERE type = 1""")
def dhop_d1(spark, d):
    """Neighbourhoods of orders within one hop."""
    hin = N.network(spark, d)
    return neighborhood.d_hop(hin, hin.of_type(N.ORDER), 1)


_D2 = f"""{_HIN},
two AS (SELECT id AS u, id AS v FROM vertices WHERE type = 0 UNION SELECT src, dst FROM edges6 WHERE src_type = 0 UNION SELECT a.src, b.dst
  FROM edges6 a JOIN edges6 b ON a.dst = b.src WHERE a.src_type = 0)"""


@query(f"WITH {_D2} SELECT u, x.type, count(*) AS n FROM two JOIN vertices x ON v = x.id GROUP BY u, x.type")
def dhop_d2(spark, d):
    """Sizes of customers' neighbourhoods within two hops."""
    hin = N.network(spark, d)
    return neighborhood.two_hop_sizes(hin, hin.of_type(N.CUSTOMER))


@query(f"""WITH {_D2},
m AS (SELECT u, x.type, count(*) AS n FROM two JOIN vertices x ON v = x.id GROUP BY u, x.type)
SELECT type, min(n) AS least, max(n) AS most FROM m GROUP BY type""")
def dhop_degree_stats(spark, d):
    """Least and most neighbours of customers by type."""
    hin = N.network(spark, d)
    return neighborhood.size_stats(neighborhood.two_hop_sizes(hin, hin.of_type(N.CUSTOMER)))


@query(f"""WITH {_H4}
SELECT o_orderkey AS u, t.type FROM orders, (SELECT unnest([1, 2]) AS type) t WHERE NOT EXISTS (SELECT 1 FROM nbr WHERE nbr.u = o_orderkey
  AND nbr.type = t.type)""")
def empty_sets(spark, d):
    """Orders without customer or supplier."""
    return neighborhood.empty_sets(N.order_supply(spark, d), N.vertices_of(spark, d, "orders", "o_orderkey").withColumnRenamed("u", "id"), [1, 2])


# -- similarity ------------------------------------------------------------------


def _measured(name: str, formula: str) -> None:
    def run(spark, d):
        nbr = N.part_words(spark, d).where("type = 2")
        return similarity.similar_pairs(nbr, name, 9).select("u", "w", "s")

    run.__name__ = f"{name}_pairs"
    query(f"WITH {_H3}, {_SIM} SELECT u, w, round({formula}, 9) AS s FROM sim WHERE type = 2 AND u < w")(run)


for _name, _formula in zip(MEASURES, ("s", "c / sqrt(na::DOUBLE * nb)", "c::DOUBLE / least(na, nb)"), strict=True):
    _measured(_name, _formula)


@query(f"WITH {_H1}, {_SIM}, {_EDGES} SELECT u, w FROM edges")
def eps_edges(spark, d):
    """Similar parts, directed, with self."""
    return similarity.similar_edges(N.part_supply(spark, d), EPS)


@query(f"""WITH {_H4},
{_SIM},
paired AS (SELECT u, w FROM sim WHERE s >= 0.3::DOUBLE GROUP BY u, w HAVING count(*) = 2),
bare AS (SELECT o_orderkey AS u FROM orders WHERE o_orderkey NOT IN (SELECT u FROM nbr WHERE type = 2))
SELECT u, w FROM paired UNION SELECT s.u, s.w FROM sim s JOIN bare a ON s.u = a.u JOIN bare b ON s.w = b.u WHERE s.type = 1""")
def eps_edges_with_empty(spark, d):
    """Similar orders; two without suppliers are alike in these."""
    return similarity.similar_edges(N.order_supply(spark, d), EPS)


@query(f"""WITH {_H3},
{_SIM},
t AS (SELECT u, w, sum(s) AS s, max(CASE WHEN type = 2 THEN 1 ELSE 0 END) AS g FROM sim GROUP BY u, w)
SELECT u, w FROM t WHERE g = 1 AND s >= 0.6::DOUBLE - 1e-12""")
def sum_edges(spark, d):
    """Parts whose similarities add up to the thresholds' sum."""
    return similarity.sum_edges(N.part_words(spark, d), EPS, 2)


@query(f"WITH {_H1}, {_SIM}, {_EDGES} SELECT u, count(*) AS n_similar FROM edges GROUP BY u")
def similar_degree(spark, d):
    """Similar parts of each part."""
    return community.similar_degree(similarity.similar_edges(N.part_supply(spark, d), EPS))


@query(f"WITH {_H1}, {_SIM}, {_EDGES} SELECT u FROM edges GROUP BY u HAVING count(*) >= 5")
def core_vertices(spark, d):
    """Core parts."""
    return community.core_vertices(similarity.similar_edges(N.part_supply(spark, d), EPS), MU)


# -- detection and search ------------------------------------------------------------


def _h1_edges(spark, d) -> DataFrame:
    return materialize(similarity.similar_edges(N.part_supply(spark, d), EPS), "similar")


def _h1_members(spark, d, edges: DataFrame | None = None) -> DataFrame:
    return materialize(community.membership(edges if edges is not None else _h1_edges(spark, d), MU), "members")


def _h1_output(spark, d) -> DataFrame:
    nbr = N.part_supply(spark, d)
    return community.detect(nbr, N.vertices_of(spark, d, "part", "p_partkey"), similarity.similar_edges(nbr, EPS), MU, [1, 2])


@query(f"{_H1_SCAN} SELECT cid, count(*) AS cores FROM clusters GROUP BY cid")
def scan_clusters(spark, d):
    """Clusters of core parts and their sizes."""
    edges = _h1_edges(spark, d)
    return community.clusters(edges, community.core_vertices(edges, MU)).groupBy("cid").agg(F.count("*").alias("cores"))


@query(f"{_H1_SCAN} SELECT cid, count(*) AS cores FROM clusters GROUP BY cid")
def scan_clusters_contracted(spark, d):
    """The same by forests of each task's own pairs."""
    edges = _h1_edges(spark, d)
    return community.clusters(edges, community.core_vertices(edges, MU), unionfind.contracted_components).groupBy("cid").agg(F.count("*").alias("cores"))


@query(f"{_H1_SCAN} SELECT v, cid, role FROM members")
def scan_members(spark, d):
    """Members of communities of parts."""
    return _h1_members(spark, d)


@query(f"{_H1_SCAN}, {_ROLES} SELECT v, role FROM output WHERE cid = -1")
def hubs_outliers(spark, d):
    """Parts outside all communities."""
    return _h1_output(spark, d).where("cid = -1").select("v", "role")


@query(f"{_H1_SCAN}, {_ROLES} SELECT v, role, cid FROM output")
def cd_output(spark, d):
    """Communities, hubs and outliers among parts."""
    return _h1_output(spark, d)


@query(f"""{_H1_SCAN},
{_ROLES},
once AS (SELECT v, min(role) AS role FROM output GROUP BY v)
SELECT (SELECT count(DISTINCT cid) FROM members) AS communities, count_if(role IN ('c', 'n')) AS members, count_if(role = 'c') AS cores,
  count_if(role = 'n') AS noncores, count_if(role = 'h') AS hubs, count_if(role = 'o') AS outliers FROM once""")
def cd_summary(spark, d):
    """Counts of a detection."""
    return community.summary(_h1_output(spark, d))


@query(f"WITH RECURSIVE {_H2}, {_SIM}, {_EDGES}, {_scan(3)} SELECT v, cid, role FROM members")
def customer_members(spark, d):
    """Members of communities of customers, cores of three."""
    return community.membership(materialize(similarity.similar_edges(N.customer_supply(spark, d), EPS), "similar"), 3)


@query(f"{_H1_SCAN} SELECT q.v AS q, m.v, m.role FROM members q JOIN members m ON q.cid = m.cid WHERE q.role = 'c' AND q.v % 10 = 0")
def scan_search_batch(spark, d):
    """Communities of every tenth part."""
    q = N.vertices_of(spark, d, "part", "p_partkey").where("u % 10 = 0").withColumnRenamed("u", "id")
    return community.search(_h1_members(spark, d), q)


@query(f"{_H1_SCAN} SELECT q.v AS q, m.v, m.role FROM members q JOIN members m ON q.cid = m.cid WHERE q.role = 'c' AND q.v % 20 = 0")
def scan_search_expand(spark, d):
    """Communities of every twentieth part, from these outwards."""
    q = N.vertices_of(spark, d, "part", "p_partkey").where("u % 20 = 0").withColumnRenamed("u", "id")
    return community.expand_search(_h1_edges(spark, d), MU, q)


_KCORE = f"""WITH RECURSIVE {_H1},
{_SIM},
{_EDGES},
alive(it, u) AS (SELECT DISTINCT 0, u FROM edges UNION ALL SELECT a.it + 1, e.u FROM edges e JOIN alive a ON e.u = a.u JOIN alive b ON e.w =
  b.u AND b.it = a.it WHERE a.it < 20 GROUP BY a.it, e.u HAVING count(*) >= 3),
kcore AS (SELECT u FROM alive WHERE it = 20)"""


@query(f"{_KCORE} SELECT u FROM kcore")
def kcore_vertices(spark, d):
    """The 3-core of similar parts."""
    return community.k_core(_h1_edges(spark, d), 3)


@query(f"""{_KCORE},
kk AS (SELECT e.u, e.w FROM edges e JOIN kcore a ON e.u = a.u JOIN kcore b ON e.w = b.u),
hit AS (SELECT u AS q, u AS v FROM kcore WHERE u % 20 = 0 UNION SELECT h.q, k.w FROM hit h JOIN kk k ON h.v = k.u)
SELECT q, v FROM hit""")
def kcore_search(spark, d):
    """Connected 3-cores of every twentieth part."""
    q = N.vertices_of(spark, d, "part", "p_partkey").where("u % 20 = 0").withColumnRenamed("u", "id")
    return community.k_core_search(_h1_edges(spark, d), 3, q)


# -- meta-paths ------------------------------------------------------------------------


_SOS = f"""{_HIN},
half AS (SELECT src, dst, count(*) AS k FROM edges6 WHERE src_type = 3 AND dst_type = 1 GROUP BY src, dst),
sos AS (SELECT a.src AS u, b.src AS w, sum(a.k * b.k)::BIGINT AS cnt FROM half a JOIN half b ON a.dst = b.dst GROUP BY a.src, b.src),
sn AS (SELECT src, dst FROM edges6 WHERE src_type = 3 AND dst_type = 4),
sns AS (SELECT a.src AS u, b.src AS w, count(*) AS cnt FROM sn a JOIN sn b ON a.dst = b.dst GROUP BY a.src, b.src)"""
_PS = """ps AS (SELECT p.u, p.w, (coalesce(2.0 * a.cnt, 0) / (ai.cnt + aj.cnt) + coalesce(2.0 * b.cnt, 0) / (bi.cnt + bj.cnt)) / 2 AS s, coalesce(2.0
  * a.cnt, 0) / (ai.cnt + aj.cnt) AS s1, coalesce(2.0 * b.cnt, 0) / (bi.cnt + bj.cnt) AS s2, a.cnt AS c1, b.cnt AS c2 FROM (SELECT u, w FROM
  sns UNION SELECT u, w FROM sos) p LEFT JOIN sns a ON a.u = p.u AND a.w = p.w LEFT JOIN sos b ON b.u = p.u AND b.w = p.w JOIN sns ai ON
  ai.u = p.u AND ai.w = p.u JOIN sns aj ON aj.u = p.w AND aj.w = p.w JOIN sos bi ON bi.u = p.u AND bi.w = p.u JOIN sos bj ON bj.u = p.w AND
  bj.w = p.w)"""


@query(f"WITH {_SOS} SELECT u, w, cnt FROM sos")
def metapath_counts(spark, d):
    """Instances of supplier - order - supplier."""
    return metapath.path_counts(N.network(spark, d), S_O_S)


@query(f"WITH {_SOS}, {_PS} SELECT u, w, round(s, 9) AS s FROM ps")
def pathsim_pairs(spark, d):
    """PathSim of suppliers by nation and by order."""
    return metapath.pathsim_pairs(N.network(spark, d), [S_N_S, S_O_S]).select("u", "w", F.round("s", 9).alias("s"))


@query(f"""WITH RECURSIVE {_SOS},
{_PS},
edges AS (SELECT u, w FROM ps WHERE c1 IS NOT NULL AND c2 IS NOT NULL AND s1 >= 0.3 AND s2 >= 0.005),
{_scan(3)}
SELECT v, cid, role FROM members""")
def pathsim_clusters(spark, d):
    """Communities of suppliers by PathSim."""
    edges = metapath.pathsim_edges(N.network(spark, d), [(S_N_S, 0.3), (S_O_S, 0.005)])
    return community.membership(materialize(edges, "similar"), 3)


@query(f"WITH {_SOS} SELECT u, w FROM sns UNION SELECT u, w FROM sos")
def induced_neighbours(spark, d):
    """Suppliers that a meta-path reaches."""
    return metapath.induced_neighbours(N.network(spark, d), [S_N_S, S_O_S])


@query(f"WITH {_SOS} SELECT u, w FROM sos WHERE u <> w")
def project_metapath(spark, d):
    """Suppliers that share an order."""
    return metapath.project(N.network(spark, d), S_O_S)


@query(f"WITH {_SOS} SELECT id AS u, count(sos.w) AS degree FROM vertices LEFT JOIN sos ON sos.u = id AND sos.w <> id WHERE type = 3 GROUP BY id")
def homo_degree(spark, d):
    """Degrees in that graph."""
    return metapath.projected_degrees(N.network(spark, d), S_O_S)


@query(f"""WITH {_HIN},
h AS (SELECT b.dst AS mid, a.edge_type AS e1, a.dst_type AS t1, b.edge_type AS e2, b.dst_type AS t2, count(*) AS k FROM edges6 a JOIN edges6
  b ON a.dst = b.src WHERE a.src_type = 3 AND b.dst_type <> a.dst_type AND b.dst_type <> 3 GROUP BY ALL),
g AS (SELECT a.src AS mid, a.edge_type AS e3, a.dst_type AS t3, b.edge_type AS e4, count(*) AS k FROM edges6 a JOIN edges6 b ON a.dst =
  b.src WHERE b.dst_type = 3 GROUP BY ALL)
SELECT e1, t1, e2, t2, e3, t3, e4, sum(h.k * g.k)::BIGINT AS cnt FROM h JOIN g ON h.mid = g.mid AND t1 = t3 GROUP BY ALL ORDER BY cnt DESC,
  e1, t1, e2, t2, e3, t3, e4 LIMIT 1001""")
def metapath_discovery_top(spark, d):
    """Most frequent meta-paths between suppliers."""
    return metapath.discover(N.network(spark, d), N.SUPPLIER)


@query(f"""WITH {_HIN},
half AS (SELECT src, dst, count(*) AS k FROM edges6 WHERE src_type = 3 AND dst_type = 1 GROUP BY src, dst),
n AS (SELECT src, sum(k) AS n FROM half GROUP BY src)
SELECT a.src AS a, b.src AS b, round(CASE WHEN a.src = b.src THEN 1.0 ELSE sum(a.k * b.k) / sqrt(x.n::DOUBLE * y.n) END, 9) AS s FROM half a
  JOIN half b ON a.dst = b.dst JOIN n x ON a.src = x.src JOIN n y ON b.src = y.src GROUP BY a.src, b.src, x.n, y.n""")
def hetesim_pairs(spark, d):
    """HeteSim of suppliers by order."""
    return metapath.hetesim(N.network(spark, d), S_O_S).select("a", "b", F.round("s", 9).alias("s"))


# s(order, order) is 1 where both are the same customer's, so pairs of orders add up by customer
_HETESIM_5_COUNTS = f"""{_HIN},
so AS (SELECT src AS s, dst AS o, count(*) AS k FROM edges6 WHERE src_type = 3 AND dst_type = 1 GROUP BY src, dst),
oc AS (SELECT src AS o, dst AS c FROM edges6 WHERE src_type = 1 AND dst_type = 0),
sc AS (SELECT s, c, sum(k) AS k FROM so JOIN oc ON so.o = oc.o GROUP BY s, c),
n AS (SELECT s, sum(k) AS n FROM so GROUP BY s)"""
_HETESIM_5_PAIRS = """SELECT a.s AS a, b.s AS b, round(CASE WHEN a.s = b.s THEN 1.0 ELSE sum(a.k * b.k) / sqrt(x.n::DOUBLE * y.n) END, 9) AS s
FROM sc a JOIN sc b ON a.c = b.c JOIN n x ON a.s = x.s JOIN n y ON b.s = y.s GROUP BY a.s, b.s, x.n, y.n"""
_HETESIM_5 = f"WITH {_HETESIM_5_COUNTS}\n{_HETESIM_5_PAIRS}"


@query(_HETESIM_5)
def hetesim_long(spark, d):
    """HeteSim of suppliers by order and customer."""
    return metapath.hetesim(N.network(spark, d), S_O_C_O_S).select("a", "b", F.round("s", 9).alias("s"))


_HETESIM_EDGES = """half AS (SELECT src, dst, count(*) AS k FROM edges6 WHERE src_type = 3 AND dst_type = 1 GROUP BY src, dst),
hn AS (SELECT src, sum(k) AS n FROM half GROUP BY src),
nation AS (SELECT src AS u, any_value(dst) AS nat FROM edges6 WHERE src_type = 3 AND dst_type = 4 GROUP BY src),
hs AS (SELECT a.src AS u, b.src AS w, CASE WHEN a.src = b.src THEN 1.0 ELSE sum(a.k * b.k) / sqrt(x.n::DOUBLE * y.n) END AS s
  FROM half a JOIN half b ON a.dst = b.dst JOIN hn x ON a.src = x.src JOIN hn y ON b.src = y.src GROUP BY a.src, b.src, x.n, y.n),
edges AS (SELECT hs.u, hs.w FROM hs JOIN nation p ON p.u = hs.u JOIN nation q ON q.u = hs.w WHERE p.nat = q.nat AND hs.s >= 0.0301)"""


@query(f"WITH RECURSIVE {_HIN}, {_HETESIM_EDGES}, {_scan(3)} SELECT v, cid, role FROM members")
def hetesim_members(spark, d):
    """Communities of suppliers by HeteSim over nation and order."""
    edges = metapath.hetesim_edges(N.network(spark, d), [(S_N_S, 0.3), (S_O_S, 0.0301)])
    return community.membership(materialize(edges, "similar"), 3)


# thresholds of communities by path, as a specification for twenty suppliers
_PATH_SPEC = "3\n1\n3 20\n-1\n-2 0.2\n2\n3 -1 4 -1 3\n0.3\n3 -1 1 -1 3\n{eps}\n"
_SUPPLIERS = """ql AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS l, count(*) OVER () AS n FROM vertices WHERE type = 3),
q AS (SELECT id FROM ql WHERE l >= 1 AND (l - 1) % greatest(1, n // 20) = 0 AND l < 1 + 20 * greatest(1, n // 20))"""
_PATH_ANSWERS = f"""{_SUPPLIERS}
SELECT c.v AS q, m.v, m.role FROM members c JOIN members m ON c.cid = m.cid WHERE c.role = 'c' AND c.v IN (SELECT id FROM q)"""
_PS_EDGES = "edges AS (SELECT u, w FROM ps WHERE c1 IS NOT NULL AND c2 IS NOT NULL AND s1 >= 0.3 AND s2 >= 0.005)"


def _twenty(hin) -> DataFrame:
    return neighborhood.query_vertices(hin, _spec(hin, _PATH_SPEC.format(eps=0.005)))


@query(f"WITH {_SOS}, {_PS}, {_PS_EDGES}, {_SUPPLIERS} SELECT u, w FROM edges WHERE u IN (SELECT id FROM q)")
def pathsim_seeded(spark, d):
    """Suppliers like each of twenty by PathSim, from these outwards."""
    hin = N.network(spark, d)
    return seeded.seeded_pathsim(hin, [(S_N_S, 0.3), (S_O_S, 0.005)], _twenty(hin))


@query(f"WITH {_HETESIM_5_COUNTS}, hs AS ({_HETESIM_5_PAIRS}), {_SUPPLIERS} SELECT a, b, s FROM hs WHERE a IN (SELECT id FROM q)")
def hetesim_seeded(spark, d):
    """HeteSim of twenty suppliers with all, by order and customer, from these outwards."""
    hin = N.network(spark, d)
    return seeded.seeded_hetesim(hin, S_O_C_O_S, _twenty(hin)).select("a", "b", F.round("s", 9).alias("s"))


@query(f"WITH RECURSIVE {_SOS}, {_PS}, {_PS_EDGES}, {_scan(3)}, {_PATH_ANSWERS}")
def pathsim_search(spark, d):
    """Communities of twenty suppliers by PathSim, walked from them."""
    hin = N.network(spark, d)
    return api.path_search(hin, _spec(hin, _PATH_SPEC.format(eps=0.005)))


@query(f"WITH RECURSIVE {_HIN}, {_HETESIM_EDGES}, {_scan(3)}, {_PATH_ANSWERS}")
def hetesim_search(spark, d):
    """Communities of twenty suppliers by HeteSim, walked from them."""
    hin = N.network(spark, d)
    return api.path_search(hin, _spec(hin, _PATH_SPEC.format(eps=0.0301)), "hetesim")


@query(f"""WITH {_SOS},
deg AS (SELECT id, count(sos.w) AS degree FROM vertices LEFT JOIN sos ON sos.u = id AND sos.w <> id WHERE type = 3 GROUP BY id)
SELECT degree, count(*) AS n FROM deg GROUP BY degree""")
def homo_degree_distribution(spark, d):
    """How many suppliers have each degree in the projection."""
    return metapath.degree_distribution(metapath.projected_degrees(N.network(spark, d), S_O_S))


# -- index -----------------------------------------------------------------------------


def _h2_vectors(spark, d) -> DataFrame:
    return materialize(similarity.common_vectors(N.customer_supply(spark, d), [1, 2]), "vectors")


# pairs of one nation are joined, not all that share a supplier
_H2_PAIRS = """x2 AS (SELECT s.u, s.v, k.v AS nat FROM nbr s JOIN nbr k ON s.u = k.u AND k.type = 1 WHERE s.type = 2),
n2 AS (SELECT u, count(*) AS n FROM x2 GROUP BY u),
c2 AS (SELECT a.u, b.u AS w, count(*) AS c FROM x2 a JOIN x2 b ON a.nat = b.nat AND a.v = b.v GROUP BY a.u, b.u),
x AS (SELECT c2.u, c2.w, c::DOUBLE / (p.n + q.n - c) AS s FROM c2 JOIN n2 p ON c2.u = p.u JOIN n2 q ON c2.w = q.u)"""
_LEVEL = """CASE WHEN s >= (floor(s * 100) + 1) / 100.0::DOUBLE THEN floor(s * 100) + 1 WHEN s < floor(s * 100) / 100.0::DOUBLE THEN floor(s * 100) - 1
  ELSE floor(s * 100) END::INTEGER"""


@query(f"""WITH {_H2}, {_H2_PAIRS} SELECT u, w, 1.0::DOUBLE AS s1, round(s, 9) AS s2 FROM x
UNION ALL SELECT a.u, b.u, 1.0::DOUBLE, 1.0::DOUBLE FROM nbr a JOIN nbr b ON a.v = b.v WHERE a.type = 1 AND b.type = 1
  AND a.u NOT IN (SELECT u FROM n2) AND b.u NOT IN (SELECT u FROM n2)""")
def similarity_index(spark, d):
    """Similarity vectors of customers."""
    return _h2_vectors(spark, d).select("u", "w", F.round(F.col("vec")[0], 9).alias("s1"), F.round(F.col("vec")[1], 9).alias("s2"))


@query(f"WITH {_H2}, {_SIM}, {_EDGES} SELECT u, w FROM edges")
def index_edges(spark, d):
    """Similar customers, from stored vectors."""
    return similarity.index_edges(_h2_vectors(spark, d), [1, 2], EPS)


@query(f"""WITH {_H2},
{_SIM},
x AS (SELECT a.u, a.w, a.s AS s1, b.s AS s2 FROM sim a JOIN sim b ON a.u = b.u AND a.w = b.w WHERE a.type = 1 AND b.type = 2)
SELECT p.u, p.w, 1 + count(q.w) AS domin_rank FROM x p LEFT JOIN x q ON p.u = q.u AND p.w <> q.w AND q.s1 >= p.s1 AND q.s2 >= p.s2 GROUP BY
  p.u, p.w""")
def domin_rank(spark, d):
    """Dominance ranks of customers' neighbours."""
    return index.dominance_rank(_h2_vectors(spark, d)).select("u", "w", "domin_rank")


_H2_LEVELS = f"""WITH RECURSIVE {_H2}, {_H2_PAIRS}, lv AS (SELECT unnest(range(0, 101)) AS lv),
alive(it, lv, u) AS (SELECT DISTINCT 0, lv, u FROM x, lv UNION ALL
  SELECT a.it + 1, a.lv, x.u FROM x JOIN alive a ON x.u = a.u JOIN alive b ON x.w = b.u AND b.it = a.it AND b.lv = a.lv
  WHERE a.it < 16 AND x.s >= a.lv / 100.0::DOUBLE GROUP BY a.it, a.lv, x.u HAVING count(*) >= 5),
tau AS (SELECT u AS v, max(lv)::INTEGER AS lv FROM alive WHERE it = 16 GROUP BY u)"""


@query(f"{_H2_LEVELS} SELECT v, lv FROM tau")
def kthres_1d(spark, d):
    """Greatest level of supplier similarity at which a customer is in the 5-core of its nation."""
    return index.k_thresholds_1d(_h2_vectors(spark, d).select("u", "w", F.col("vec")[1].alias("s")), MU)


@query(f"{_H2_LEVELS} SELECT v, '100 ' || lv AS thres FROM tau")
def kthres_2d(spark, d):
    """Skyline of levels at which a customer is in the 5-core; a pair's nations are the same or it is none."""
    return index.k_thresholds(_h2_vectors(spark, d), MU, 2).select("v", F.concat_ws(" ", F.col("thres").cast("array<string>")).alias("thres"))


_H5 = """nbr AS (SELECT c_custkey AS u, 1 AS type, CAST(c_nationkey AS VARCHAR) AS v FROM customer UNION SELECT o_custkey, 2, o_orderpriority FROM orders
  UNION SELECT o_custkey, 3, CAST(l_suppkey AS VARCHAR) FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION SELECT o_custkey, 4, o_orderstatus FROM orders
  UNION SELECT c_custkey, 5, CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment FROM customer)"""


def _lattice_sql(key: int, sides: list[int], swept: int, k: int) -> str:
    """Every cell of the levels that occur, peeled on its own: pairs with the same ``key``, alike in the other types."""
    types = [key, *sides, swept]
    n = ", ".join(f"count_if(type = {t}) AS n{t}" for t in types)
    c = ", ".join(f"count_if(a.type = {t}) AS c{t}" for t in types)
    # two customers without orders are alike in these types
    s = ", ".join(f"CASE WHEN p.n{t} = 0 AND q.n{t} = 0 THEN 1.0::DOUBLE ELSE c{t}::DOUBLE / (p.n{t} + q.n{t} - c{t}) END AS s{t}" for t in types)
    levels = ", ".join(f"{_LEVEL.replace('s *', f's{t} *').replace('WHEN s ', f'WHEN s{t} ')} AS l{t}" for t in [*sides, swept])
    cells = ", ".join(f"(SELECT DISTINCT l{t} AS m{t} FROM lv) AS g{t}" for t in [*sides, swept])
    at = [f"m{t}" for t in [*sides, swept]]
    same = " AND ".join(f"a.{m} = b.{m}" for m in at)
    inside = " AND ".join(f"x.l{t} >= a.m{t}" for t in [*sides, swept])
    best = " AND ".join(f"o.{m} >= p.{m}" for m in at)
    differ = " OR ".join(f"o.{m} > p.{m}" for m in at)
    text = " || ' ' || ".join(["'100'" if t == key else f"p.m{t}" for t in sorted(types)])
    return f"""WITH RECURSIVE {_H5}, sizes AS (SELECT u, {n} FROM nbr GROUP BY u),
near AS (SELECT a.u, b.u AS w FROM nbr a JOIN nbr b ON a.type = {key} AND b.type = {key} AND a.v = b.v),
common AS (SELECT n.u, n.w, {c} FROM near n JOIN nbr a ON a.u = n.u LEFT JOIN nbr b ON b.u = n.w AND b.type = a.type AND b.v = a.v WHERE b.u IS NOT NULL GROUP BY n.u, n.w),
sims AS (SELECT c.u, c.w, {s} FROM common c JOIN sizes p ON p.u = c.u JOIN sizes q ON q.u = c.w),
lv AS (SELECT u, w, {levels} FROM sims WHERE {" AND ".join(f"s{t} > 0" for t in types)}),
alive AS (SELECT 0 AS it, {", ".join(at)}, u FROM (SELECT DISTINCT u FROM lv), {cells} UNION ALL
  SELECT a.it + 1, {", ".join(f"a.{m}" for m in at)}, x.u FROM lv x JOIN alive a ON x.u = a.u JOIN alive b ON x.w = b.u AND b.it = a.it AND {same}
  WHERE a.it < 14 AND {inside} GROUP BY a.it, {", ".join(f"a.{m}" for m in at)}, x.u HAVING count(*) >= {k}),
p AS (SELECT * FROM alive WHERE it = 14)
SELECT p.u AS v, {text} AS thres FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.u = p.u AND {best} AND ({differ}))"""


def _profile_thresholds(spark, d, types: list[int], k: int) -> DataFrame:
    vectors = materialize(similarity.common_vectors(N.customer_profile(spark, d), types), "vectors")
    return skyline.lattice_thresholds(vectors, k, len(types)).select("v", F.concat_ws(" ", F.col("thres").cast("array<string>")).alias("thres"))


@query(_lattice_sql(1, [2], 3, 3))
def kthres_3d(spark, d):
    """Skylines of three levels at which a customer is in the 3-core: nation, priorities and suppliers of its orders."""
    return _profile_thresholds(spark, d, [1, 2, 3], 3)


@query(_lattice_sql(5, [2, 4], 3, 3))
def kthres_4d(spark, d):
    """Skylines of four levels: nation with segment, priorities, suppliers and states of its orders."""
    return _profile_thresholds(spark, d, [2, 3, 4, 5], 3)


@query(f"{_H2_LEVELS} SELECT v, '100 ' || lv AS thres FROM tau")
def kthres_lattice(spark, d):
    """The skylines of kthres_2d by halving the lattice."""
    return skyline.lattice_thresholds(_h2_vectors(spark, d), MU, 2).select("v", F.concat_ws(" ", F.col("thres").cast("array<string>")).alias("thres"))


@query(f"""WITH {_H2},
{_H2_PAIRS},
l AS (SELECT u, w, {_LEVEL} AS l FROM x WHERE u <> w)
SELECT 1 AS k, u AS v, '100 100' AS thres FROM nbr WHERE type = 1 UNION ALL SELECT 2, u, '100 ' || max(l) FROM l GROUP BY u""")
def kthres_small(spark, d):
    """The same for the 1-core and the 2-core."""
    vectors = _h2_vectors(spark, d)
    text = F.concat_ws(" ", F.col("thres").cast("array<string>")).alias("thres")
    one, two = (index.k_thresholds(vectors, k, 2).select(F.lit(k).alias("k"), "v", text) for k in (1, 2))
    return one.unionByName(two)


@query(f"""WITH RECURSIVE {_H2},
{_SIM},
{_EDGES},
alive(it, u) AS (SELECT DISTINCT 0, u FROM edges UNION ALL SELECT a.it + 1, e.u FROM edges e JOIN alive a ON e.u = a.u JOIN alive b ON e.w =
  b.u AND b.it = a.it WHERE a.it < 20 GROUP BY a.it, e.u HAVING count(*) >= 5)
SELECT u AS v FROM alive WHERE it = 20""")
def index_core_test(spark, d):
    """Customers whose thresholds reach the query's: those in its 5-core."""
    return index.index_cores(index.k_thresholds(_h2_vectors(spark, d), MU, 2), [0.3, 0.3])


def _h2_level(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = materialize(_h2_vectors(spark, d).select("u", "w", F.col("vec")[1].alias("s")), "s")
    tau = materialize(index.k_thresholds_1d(edges, MU), "tau")
    return edges, tau, materialize(index.level_clusters(edges, tau), "levels")


# clusters at each level by spreading the least vertex; a nation's customers are few steps apart
_H2_TREE = f"""{_H2_LEVELS}, kept AS (SELECT DISTINCT lv FROM tau),
pairs AS (SELECT k.lv, x.u, x.w FROM x JOIN tau a ON a.v = x.u JOIN tau b ON b.v = x.w JOIN kept k ON k.lv <= a.lv AND k.lv <= b.lv AND x.s >= k.lv / 100.0::DOUBLE),
spread(it, lv, u, c) AS (SELECT DISTINCT 0, lv, u, u FROM pairs UNION ALL
  SELECT s.it + 1, p.lv, p.u, min(s.c) FROM pairs p JOIN spread s ON s.lv = p.lv AND s.u = p.w WHERE s.it < 16 GROUP BY s.it, p.lv, p.u),
levels AS (SELECT lv, u AS v, c AS cid FROM spread WHERE it = 16)"""


@query(f"""{_H2_TREE}, sets AS (SELECT lv, cid, count(*) AS size, list(v ORDER BY v) AS vs FROM levels GROUP BY lv, cid),
nodes AS (SELECT max(lv) AS lv, cid, size, vs FROM sets GROUP BY cid, size, vs),
up AS (SELECT n.lv, n.cid, max(p.lv) AS plv, arg_max(p.cid, p.lv) AS pcid FROM nodes n JOIN nodes p ON p.lv < n.lv AND list_contains(p.vs, n.cid) GROUP BY n.lv, n.cid)
SELECT nodes.lv, nodes.cid, size, plv AS parent_lv, pcid AS parent_cid FROM nodes LEFT JOIN up ON up.lv = nodes.lv AND up.cid = nodes.cid""")
def mutree_levels(spark, d):
    """Clusters of customers at every level, as a tree."""
    return index.level_tree(_h2_level(spark, d)[2])


@query(f"""{_H2_TREE}, base AS (SELECT min(lv) AS lv FROM kept WHERE lv >= 25), core AS (SELECT v, cid FROM levels WHERE lv = (SELECT lv FROM base))
SELECT v, cid, true AS core FROM core UNION ALL
SELECT DISTINCT x.w, core.cid, false FROM core JOIN x ON x.u = core.v WHERE x.s >= 0.25::DOUBLE AND x.w NOT IN (SELECT v FROM core)""")
def mutree_query(spark, d):
    """Clusters of customers at similarity 0.25."""
    edges, tau, levels = _h2_level(spark, d)
    return index.tree_query(levels, edges, tau, 0.25)


@query(f"""{_H2_TREE}, sets AS (SELECT lv, cid, count(*) AS size, list(v ORDER BY v) AS vs FROM levels GROUP BY lv, cid),
nodes AS (SELECT max(lv) AS lv, cid, size, vs FROM sets GROUP BY cid, size, vs),
up AS (SELECT n.lv, n.cid, max(p.lv) AS plv, arg_max(p.cid, p.lv) AS pcid FROM nodes n JOIN nodes p ON p.lv < n.lv AND list_contains(p.vs, n.cid) GROUP BY n.lv, n.cid)
SELECT nodes.lv, nodes.cid, size, plv AS parent_lv, pcid AS parent_cid FROM nodes LEFT JOIN up ON up.lv = nodes.lv AND up.cid = nodes.cid""")
def mutree_inserted(spark, d):
    """The same tree from a merge forest: that of one half of the pairs, with the other half inserted."""
    edges = materialize(_h2_vectors(spark, d).select("u", "w", F.col("vec")[1].alias("s")), "s")
    tau = materialize(index.k_thresholds_1d(edges, MU), "tau")
    pairs = materialize(forest.weighted_pairs(edges, tau), "weighted")
    half = (F.col("a") + F.col("b")) % 2 == 0
    tree = materialize(forest.spanning_forest(pairs.where(half)), "forest")
    return forest.forest_tree(materialize(forest.inserted(tree, pairs.where(~half)), "forest"), tau)


@query(f"""WITH RECURSIVE {_H2}, {_H2_PAIRS}, l AS (SELECT u, w, {_LEVEL} AS lv FROM x WHERE u < w AND s >= 0.25::DOUBLE),
both_ends AS (SELECT u, w FROM l UNION ALL SELECT w, u FROM l),
reach AS (SELECT c_custkey AS u, c_custkey AS w FROM customer UNION SELECT r.u, b.w FROM reach r JOIN both_ends b ON r.w = b.u),
named AS (SELECT u AS v, min(w) AS component FROM reach GROUP BY u),
sets AS (SELECT component, count(DISTINCT l.lv) AS n_levels, string_agg(DISTINCT l.lv::VARCHAR, ' ' ORDER BY l.lv::VARCHAR) AS levels FROM l JOIN named ON named.v = l.u GROUP BY component)
SELECT component, count(*) AS size, bool_or(v % 20 = 0) AS fixed, coalesce(any_value(n_levels), 0) AS n_levels, coalesce(any_value(levels), '') AS levels
FROM named LEFT JOIN sets USING (component) GROUP BY component""")
def flagged_components(spark, d):
    """Components of customers alike by a quarter, their pairs' levels, and whether they hold one of every twentieth."""
    x = _h2_vectors(spark, d).select(F.col("u").alias("a"), F.col("w").alias("b"), F.col("vec")[1].alias("s")).where("a < b and s >= 0.25D")
    # customers without a supplier are alike in having none, and not compared here
    listed = N.customer_supply(spark, d).where("type = 2").select(F.col("u").alias("a")).distinct()
    x = x.join(listed, "a", "left_semi").select("a", "b", level(F.col("s")).alias("lv"))
    vertices = N.vertices_of(spark, d, "customer", "c_custkey").select(F.col("u").alias("v"), (F.col("u") % 20 == 0).alias("fixed"))
    got = components.flagged_components(materialize(x, "pairs"), vertices)
    levels = F.concat_ws(" ", F.array_sort(bits_levels(F.col("low"), F.col("high")).cast("array<string>")))
    return got.select("component", "size", "fixed", bits_size(F.col("low"), F.col("high")).cast("long").alias("n_levels"), levels.alias("levels"))


@query(f"WITH {_H1}, {_SIM}, {_EDGES} SELECT u FROM edges GROUP BY u HAVING count(*) >= 5")
def core_vertices_bounded(spark, d):
    """Core parts, found by bounds."""
    return bounds.bounded_cores(N.part_supply(spark, d), EPS, MU).cores


# -- from a specification --------------------------------------------------------------------


_SPEC = "3\n2\n0 20\n-1\n3 0.3\n4 0.3\n"
_SPEC_NBR = f"{_D2}, nbr AS (SELECT u, x.type, v FROM two JOIN vertices x ON v = x.id WHERE x.type IN (3, 4))"
_SPEC_SCAN = f"WITH RECURSIVE {_SPEC_NBR}, {_SIM}, {_EDGES}, {_scan(3)}"
_SPEC_QUERIES = """ql AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS l, count(*) OVER () AS n FROM vertices WHERE type = 0),
q AS (SELECT id FROM ql WHERE l >= 1 AND (l - 1) % (n // 20) = 0 AND l < 1 + 20 * (n // 20))"""
_SPEC_SEARCH = f"""{_SPEC_SCAN},
{_SPEC_QUERIES}
SELECT c.v AS q, m.v, m.role FROM members c JOIN members m ON c.cid = m.cid WHERE c.role = 'c' AND c.v IN (SELECT id FROM q)"""
_SPEC_DETECT = f"""{_SPEC_SCAN}, others AS (SELECT id AS v FROM vertices WHERE type = 0 AND id NOT IN (SELECT v FROM members)),
near AS (SELECT a.u, a.w FROM sim a JOIN sim b ON a.u = b.u AND a.w = b.w WHERE a.type = 3 AND b.type = 4),
hubs AS (SELECT o.v FROM others o JOIN near x ON x.u = o.v JOIN members m ON m.v = x.w GROUP BY o.v HAVING count(DISTINCT m.cid) > 1)
SELECT v, role, cid FROM members UNION ALL SELECT v, CASE WHEN v IN (SELECT v FROM hubs) THEN 'h' ELSE 'o' END, -1 FROM others"""


def _spec(hin, text: str = _SPEC):
    return parse_spec(text, hin.vertices.select("type").distinct().count())


def _stored(spark, hin, spec, **kwargs) -> api.Index:
    return api.build_index(hin, spec, f"{shared_dir(spark)}/meshwork/index-{uuid.uuid4().hex}", spec.mu, **kwargs)


@query(_SPEC_SEARCH)
def search_from_spec(spark, d):
    """Communities of twenty customers, by nations and suppliers within two hops, from a query specification."""
    hin = N.network(spark, d)
    return api.community_search(hin, _spec(hin))


@query(_SPEC_SEARCH)
def search_local(spark, d):
    """The same answers from the twenty customers outwards."""
    hin = N.network(spark, d)
    return api.local_search(hin, _spec(hin))


@query(_SPEC_SEARCH)
def search_by_index(spark, d):
    """The same answers from a stored index."""
    hin = N.network(spark, d)
    return api.index_search(hin, _spec(hin), _stored(spark, hin, _spec(hin)))


@query(_SPEC_DETECT)
def detect_from_spec(spark, d):
    """All communities, hubs and outliers of customers, from a query specification."""
    hin = N.network(spark, d)
    return api.community_detect(hin, _spec(hin))


@query(_SPEC_DETECT)
def detect_by_index(spark, d):
    """The same from a stored index that also answers subsets of its types."""
    hin = N.network(spark, d)
    return api.community_detect(hin, _spec(hin), _stored(spark, hin, _spec(hin), subsets=True))


_HALF = """first_half AS (SELECT id AS u FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS l, count(*) OVER () AS n FROM vertices WHERE type = 0)
  WHERE l < n * 50 // 100)"""


@query(
    f"WITH RECURSIVE {_SPEC_NBR.replace('nbr AS', 'nbr0 AS')}, {_HALF}, nbr AS (SELECT nbr0.* FROM nbr0 SEMI JOIN first_half USING (u)), {_SIM}, {_EDGES}, "
    "alive(it, u) AS (SELECT DISTINCT 0, u FROM edges UNION ALL SELECT a.it + 1, e.u FROM edges e JOIN alive a ON e.u = a.u JOIN alive b ON e.w = b.u AND b.it = a.it WHERE a.it < 20 GROUP BY a.it, e.u HAVING count(*) >= 3), "
    f"kcore AS (SELECT u FROM alive WHERE it = 20), kk AS (SELECT e.u, e.w FROM edges e JOIN kcore a ON e.u = a.u JOIN kcore b ON e.w = b.u), {_SPEC_QUERIES}, "
    "hit AS (SELECT u AS q, u AS v FROM kcore WHERE u IN (SELECT id FROM q) UNION SELECT h.q, k.w FROM hit h JOIN kk k ON h.v = k.u) SELECT q, v FROM hit"
)
def kcore_search_scaled(spark, d):
    """Connected 3-cores of twenty customers, among the first half of all customers."""
    hin = N.network(spark, d)
    return api.kcore_search(hin, _spec(hin), scale=50)


@query(
    f"WITH RECURSIVE {_SPEC_NBR}, {_SIM}, {_EDGES}, "
    "alive(it, u) AS (SELECT DISTINCT 0, u FROM edges UNION ALL SELECT a.it + 1, e.u FROM edges e JOIN alive a ON e.u = a.u JOIN alive b ON e.w = b.u AND b.it = a.it WHERE a.it < 20 GROUP BY a.it, e.u HAVING count(*) >= 3), "
    f"kcore AS (SELECT u FROM alive WHERE it = 20), kk AS (SELECT e.u, e.w FROM edges e JOIN kcore a ON e.u = a.u JOIN kcore b ON e.w = b.u), {_SPEC_QUERIES}, "
    "hit AS (SELECT u AS q, u AS v FROM kcore WHERE u IN (SELECT id FROM q) UNION SELECT h.q, k.w FROM hit h JOIN kk k ON h.v = k.u) SELECT q, v FROM hit"
)
def kcore_search_by_index(spark, d):
    """Connected 3-cores of twenty customers among all, from stored thresholds."""
    hin = N.network(spark, d)
    return api.index_kcore_search(hin, _spec(hin), _stored(spark, hin, _spec(hin)))


@query(f"""{_SPEC_SCAN},
{_SPEC_QUERIES},
f AS (SELECT c.v AS q, m.v, m.role FROM members c JOIN members m ON c.cid = m.cid WHERE c.role = 'c' AND c.v IN (SELECT id FROM q)),
r AS (SELECT q, count(*) AS size, count_if(role = 'c') AS cores FROM f GROUP BY q)
SELECT (SELECT count(*) FROM q) AS queries, count(*) AS answered, round(avg(size), 9) AS mean_size, round(avg(cores), 9) AS mean_cores FROM
  r""")
def batch_report(spark, d):
    """Averages over the answers of twenty customers."""
    hin = N.network(spark, d)
    spec = _spec(hin)
    got = api.batch_report(materialize(api.community_search(hin, spec), "found"), neighborhood.query_vertices(hin, spec))
    return got.select("queries", "answered", F.round("mean_size", 9).alias("mean_size"), F.round("mean_cores", 9).alias("mean_cores"))


@query(f"""{_SPEC_SCAN},
{_SPEC_QUERIES}
SELECT c.v AS q, count(*) AS size, count_if(m.role = 'c') AS cores, count_if(m.role = 'n') AS noncores FROM members c JOIN members m ON
  c.cid = m.cid WHERE c.role = 'c' AND c.v IN (SELECT id FROM q) GROUP BY c.v""")
def search_report(spark, d):
    """Sizes of those answers."""
    hin = N.network(spark, d)
    return api.search_report(api.community_search(hin, _spec(hin)))


@query(f"""WITH {_H3},
{_SIM},
p AS (SELECT u, w, s, c / sqrt(na::DOUBLE * nb) AS k, type FROM sim WHERE u < w)
SELECT u, w, round(sum(s) / 2, 9) AS avg_jaccard, round(sum(k) / 2, 9) AS avg_cosine FROM p GROUP BY u, w""")
def avg_jac_cos(spark, d):
    """Mean similarities of parts over brand and words, of pairs that share any."""
    return similarity.mean_similarities(N.part_words(spark, d), [1, 2], {"jaccard": "avg_jaccard", "cosine": "avg_cosine"}, 9)


@query(f"""WITH RECURSIVE {_H2},
{_SIM},
{_EDGES},
{_scan(3)},
m AS (SELECT u, w, sum(s) / 2 AS s FROM sim GROUP BY u, w)
SELECT a.cid, count(*) AS core_edges, round(avg(m.s), 9) AS mean_similarity FROM edges e JOIN clusters a ON a.u = e.u JOIN clusters b ON b.u
  = e.w AND b.cid = a.cid JOIN m ON m.u = e.u AND m.w = e.w WHERE e.u <> e.w GROUP BY a.cid""")
def core_similarity(spark, d):
    """Similar pairs among the cores of each community of customers, and their mean similarity."""
    vectors = _h2_vectors(spark, d)
    edges = materialize(similarity.index_edges(vectors, [1, 2], EPS), "similar")
    got = metrics.core_similarity(vectors, edges, community.membership(edges, 3))
    return got.select("cid", "core_edges", F.round("mean_similarity", 9).alias("mean_similarity"))


@query(f"""WITH RECURSIVE {_SOS},
{_PS},
edges AS (SELECT u, w FROM ps WHERE c1 IS NOT NULL AND c2 IS NOT NULL AND s1 >= 0.3 AND s2 >= 0.005),
{_scan(3)},
mm AS (SELECT DISTINCT v, cid FROM members)
SELECT a.cid, round(sum(CASE WHEN a.v = b.v THEN 1.0 ELSE coalesce(ps.s, 0) END) / count(*), 9) AS avg_pathsim FROM mm a JOIN mm b ON a.cid
  = b.cid LEFT JOIN ps ON ps.u = a.v AND ps.w = b.v GROUP BY a.cid""")
def community_pathsim(spark, d):
    """Mean PathSim inside communities of suppliers."""
    hin = N.network(spark, d)
    members = community.membership(materialize(metapath.pathsim_edges(hin, [(S_N_S, 0.3), (S_O_S, 0.005)]), "similar"), 3)
    return metapath.mean_pathsim(hin, [S_N_S, S_O_S], materialize(members, "members")).select("cid", F.round("avg_pathsim", 9).alias("avg_pathsim"))


# -- metrics ------------------------------------------------------------------------------


@query(f"""{_H1_SCAN},
z AS (SELECT cid, count(DISTINCT v) AS size, count(DISTINCT CASE WHEN role = 'c' THEN v END) AS core_num FROM members GROUP BY cid),
e AS (SELECT a.cid, count(*) AS edge_num FROM edges JOIN members a ON a.v = u JOIN members b ON b.v = w AND a.cid = b.cid GROUP BY a.cid)
SELECT z.cid, size, core_num, edge_num, round(edge_num::DOUBLE / size, 9) AS density FROM z JOIN e ON z.cid = e.cid""")
def community_density(spark, d):
    """Size and density of communities of parts."""
    return metrics.density(edges := _h1_edges(spark, d), _h1_members(spark, d, edges)).withColumn("density", F.round("density", 9))


@query(f"""{_H1_SCAN},
e AS (SELECT a.cid, u, w FROM edges JOIN members a ON a.v = u JOIN members b ON b.v = w AND a.cid = b.cid),
deg AS (SELECT cid, u, count(*) AS n FROM e GROUP BY cid, u),
t AS (SELECT x.cid, x.u, count(*) AS t FROM e x JOIN e y ON x.cid = y.cid AND x.u = y.u AND x.w < y.w JOIN e z ON z.cid = x.cid AND z.u =
  x.w AND z.w = y.w GROUP BY x.cid, x.u),
l AS (SELECT deg.cid, CASE WHEN n < 2 THEN 0 ELSE 2.0::DOUBLE * coalesce(t, 0) / (n * (n - 1)) END AS c FROM deg LEFT JOIN t ON deg.cid =
  t.cid AND deg.u = t.u),
z AS (SELECT cid, count(DISTINCT v) AS size FROM members GROUP BY cid)
SELECT z.cid, round(sum(c) / any_value(size), 9) AS cc FROM z JOIN l ON z.cid = l.cid GROUP BY z.cid""")
def community_cc(spark, d):
    """Clustering coefficients of communities of parts."""
    return metrics.clustering(edges := _h1_edges(spark, d), _h1_members(spark, d, edges)).select("cid", F.round("cc", 9).alias("cc"))


@query(f"""{_H1_SCAN},
e AS (SELECT a.cid, u, w FROM edges JOIN members a ON a.v = u JOIN members b ON b.v = w AND a.cid = b.cid WHERE u <> w),
s AS (SELECT cid, v, row_number() OVER (PARTITION BY cid ORDER BY v) AS r FROM members),
bfs AS (SELECT cid, v AS s, v AS u, 0 AS d FROM s WHERE r <= 10 UNION SELECT b.cid, b.s, e.w, b.d + 1 FROM bfs b JOIN e ON b.cid = e.cid AND
  b.u = e.u WHERE b.d < 16)
SELECT cid, max(d) AS diameter FROM (SELECT cid, s, u, min(d) AS d FROM bfs GROUP BY cid, s, u) GROUP BY cid""")
def community_diameter(spark, d):
    """Lower bounds of the diameters of communities of parts, from ten starts."""
    return metrics.diameter(edges := _h1_edges(spark, d), _h1_members(spark, d, edges))


@query(f"""{_H1_SCAN},
m AS (SELECT DISTINCT cid, v, row_number() OVER (PARTITION BY cid ORDER BY v) AS r, count(*) OVER (PARTITION BY cid) AS n FROM (SELECT
  DISTINCT cid, v FROM members)),
p AS (SELECT a.cid, a.v AS a, b.v AS b, CASE WHEN a.v = b.v THEN 1.0 ELSE coalesce(avg(s.s), 0) END AS j, CASE WHEN a.v = b.v THEN 1.0 ELSE
  coalesce(avg(s.c / sqrt(s.na::DOUBLE * s.nb)), 0) END AS k FROM m a JOIN m b ON a.cid = b.cid LEFT JOIN sim s ON s.u = a.v AND s.w = b.v
  WHERE a.r <= 100 GROUP BY a.cid, a.v, b.v)
SELECT cid, round(avg(j), 9) AS avg_jaccard, round(avg(k), 9) AS avg_cosine FROM p GROUP BY cid""")
def community_pair_sim(spark, d):
    """Mean similarity of the 100 least members and all members, inside communities of parts."""
    got = metrics.pair_similarity(N.part_supply(spark, d), _h1_members(spark, d), [1, 2])
    return got.select("cid", F.round("avg_jaccard", 9).alias("avg_jaccard"), F.round("avg_cosine", 9).alias("avg_cosine"))


# every member starts, and a round keeps the pairs that are new
_FARTHEST = """bfs AS (SELECT DISTINCT cid, v AS s, v AS u, 0 AS d FROM members UNION SELECT b.cid, b.s, e.w, b.d + 1 FROM bfs b JOIN e ON b.cid = e.cid AND
  b.u = e.u WHERE b.d < 30)
SELECT cid, max(d) AS diameter FROM (SELECT cid, s, u, min(d) AS d FROM bfs GROUP BY cid, s, u) GROUP BY cid"""


@query(f"""{_H1_SCAN},
e AS (SELECT DISTINCT a.cid, u, w FROM edges JOIN members a ON a.v = u JOIN members b ON b.v = w AND a.cid = b.cid WHERE u <> w),
{_FARTHEST}""")
def community_diameter_exact(spark, d):
    """Diameters of communities of parts over their similar pairs."""
    edges = _h1_edges(spark, d)
    return exact_diameter(linked(edges), _h1_members(spark, d, edges))


@query(f"""{_SPEC_SCAN},
buys AS (SELECT DISTINCT o.src AS c, p.dst AS p FROM edges6 o JOIN edges6 p ON o.dst = p.src WHERE o.src_type = 0 AND o.dst_type = 1 AND p.dst_type = 2),
e AS (SELECT DISTINCT a.cid, x.c AS u, y.c AS w FROM buys x JOIN buys y ON x.p = y.p AND x.c <> y.c JOIN members a ON a.v = x.c JOIN members b
  ON b.v = y.c AND a.cid = b.cid),
{_FARTHEST}""")
def community_diameter_induced(spark, d):
    """Diameters of communities of customers over orders of the same part, inside the community."""
    hin = N.network(spark, d)
    spec = _spec(hin)
    members = community.membership(materialize(api.similar(hin, spec, enough=spec.mu), "similar"), spec.mu)
    return exact_diameter(induced(hin, [C_O_P_O_C]), materialize(members, "members"))


@query(f"""{_H1_SCAN},
m AS (SELECT DISTINCT cid, v FROM members),
p AS (SELECT a.cid, a.v AS a, b.v AS b, CASE WHEN a.v = b.v THEN 1.0 ELSE coalesce(avg(s.s), 0) END AS j, CASE WHEN a.v = b.v THEN 1.0 ELSE
  coalesce(avg(s.c / sqrt(s.na::DOUBLE * s.nb)), 0) END AS k FROM m a JOIN m b ON a.cid = b.cid LEFT JOIN sim s ON s.u = a.v AND s.w = b.v
  GROUP BY a.cid, a.v, b.v)
SELECT cid, round(avg(j), 9) AS avg_jaccard, round(avg(k), 9) AS avg_cosine FROM p GROUP BY cid""")
def community_pair_sim_exact(spark, d):
    """Mean similarity of all members, inside communities of parts."""
    got = metrics.pair_similarity(N.part_supply(spark, d), _h1_members(spark, d), [1, 2], None)
    return got.select("cid", F.round("avg_jaccard", 9).alias("avg_jaccard"), F.round("avg_cosine", 9).alias("avg_cosine"))


_TRUTH = """truth AS (SELECT p_partkey AS id, CASE WHEN p_size <= 5 THEN 'o' ELSE p_type END AS cluster_id FROM part),
pred AS (SELECT v AS id, CASE WHEN cid < 0 THEN 'o' ELSE CAST(cid AS VARCHAR) END AS cluster_id FROM output)"""
_F1 = """np AS (SELECT cluster_id, count(DISTINCT id) AS n FROM pred GROUP BY cluster_id),
nt AS (SELECT cluster_id, count(*) AS n FROM truth GROUP BY cluster_id),
f AS (SELECT p.cluster_id, t.cluster_id AS true_id, count(DISTINCT p.id)::DOUBLE AS c FROM pred p JOIN truth t ON p.id = t.id GROUP BY
  p.cluster_id, t.cluster_id),
g AS (SELECT f.cluster_id, true_id, 2 * (c / np.n) * (c / nt.n) / (c / np.n + c / nt.n) AS f1 FROM f JOIN np ON f.cluster_id = np.cluster_id
  JOIN nt ON f.true_id = nt.cluster_id),
best AS (SELECT np.cluster_id, coalesce(max(f1), 0) AS f1 FROM np LEFT JOIN g ON np.cluster_id = g.cluster_id AND true_id <> 'o' WHERE
  np.cluster_id <> 'o' GROUP BY np.cluster_id),
out_f1 AS (SELECT coalesce(max(f1), 0) AS f1 FROM g WHERE cluster_id = 'o' AND true_id = 'o')"""


def _truth(spark, d) -> DataFrame:
    return N.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 5, F.lit("o")).otherwise(F.col("p_type")).alias("cluster_id"))


@query(f"{_H1_SCAN}, {_ROLES}, {_TRUTH}, {_F1} SELECT cluster_id, round(f1, 9) AS f1 FROM best")
def f1_best_match(spark, d):
    """Best F1 of each community of parts over part types."""
    return metrics.best_match_f1(as_evaluation(_h1_output(spark, d)), _truth(spark, d)).select("cluster_id", F.round("f1", 9).alias("f1"))


@query(f"{_H1_SCAN}, {_ROLES}, {_TRUTH}, {_F1} SELECT round(f1, 9) AS f1 FROM out_f1")
def f1_outlier(spark, d):
    """F1 of the outliers."""
    return metrics.outlier_f1(as_evaluation(_h1_output(spark, d)), _truth(spark, d)).select(F.round("f1", 9).alias("f1"))


@query(f"{_H1_SCAN}, {_ROLES}, {_TRUTH}, {_F1} SELECT round(avg(f1), 9) AS mean_f1 FROM (SELECT f1 FROM best UNION ALL SELECT f1 FROM out_f1)")
def f1_mean(spark, d):
    """Mean F1 over communities and outliers."""
    return metrics.mean_f1(as_evaluation(_h1_output(spark, d)), _truth(spark, d)).select(F.round("mean_f1", 9).alias("mean_f1"))


# -- labels -----------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderpriority, share FROM (SELECT o_custkey, o_orderpriority, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY
  o_custkey), 2) AS share, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY
  o_custkey, o_orderpriority) WHERE r = 1""")
def label_mode_share(spark, d):
    """Most frequent priority of each customer's orders, and its share."""
    return labels.mode_share(N.table(spark, d, "orders"), "o_custkey", "o_orderpriority")


_AUTHORS = """a AS (SELECT c_custkey AS id, count(o_orderkey) AS degree, CAST(c_nationkey AS INTEGER) AS hindex FROM customer LEFT JOIN orders ON
  o_custkey = c_custkey GROUP BY c_custkey, c_nationkey)"""


def _authors(spark, d) -> DataFrame:
    c, o = N.table(spark, d, "customer"), N.table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("hindex")).agg(F.count("o_orderkey").alias("degree")).select("id", "degree", "hindex")


@query("""WITH m AS (SELECT o_custkey AS id, o_orderpriority AS label, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_custkey), 2) AS
  share, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_custkey,
  o_orderpriority),
g AS (SELECT o_custkey AS id, count(*) AS degree FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey)
SELECT id, CAST(c_nationkey AS INTEGER) AS hindex, label, share, coalesce(degree, 0) AS degree FROM customer JOIN m ON m.id = c_custkey LEFT
  JOIN g USING (id) WHERE r = 1""")
def label_authors(spark, d):
    """Modal priority of each customer beside its nation and its number of large orders."""
    o = N.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label"), "o_totalprice")
    attributes = N.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("hindex"))
    degrees = o.where("o_totalprice > 100000").groupBy("id").agg(F.count("*").alias("degree"))
    return labels.author_table(labels.mode_share(o, "id", "label"), attributes, degrees).select("id", "hindex", "label", "share", "degree")


@query(f"WITH {_AUTHORS} SELECT id, degree, hindex, degree <= 2 OR (hindex <= 2 AND degree > 2) AS outlier FROM a")
def label_outlier_rule(spark, d):
    """Outliers by degree and rank, the whole of the second group."""
    return labels.outlier_labels(_authors(spark, d), share=1.0)


@query(f"""WITH {_AUTHORS}
SELECT count_if(degree <= 2) AS low_degree, count_if(hindex <= 2) AS low_hindex, count_if(hindex <= 2 AND degree > 2) AS only_hindex FROM a""")
def label_condition_counts(spark, d):
    """Rows under the label conditions."""
    return labels.condition_counts(_authors(spark, d))


@query("""SELECT p_brand, string_agg(w, ' ' ORDER BY w) AS topics FROM (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)
  GROUP BY p_brand""")
def topic_merge(spark, d):
    """Words of each brand's part names."""
    p = N.table(spark, d, "part").select("p_brand", F.split("p_name", " ").alias("topics"))
    return labels.merge_topics(p, "p_brand", "topics").select("p_brand", F.concat_ws(" ", "topics").alias("topics"))


@query("""SELECT a, string_agg(v, ' ' ORDER BY v) AS venues, string_agg(DISTINCT t, ' ' ORDER BY t) AS topics FROM (SELECT o_custkey AS a,
  CAST(l_suppkey AS VARCHAR) AS v, p_brand AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)
  GROUP BY a""")
def two_hop_bags(spark, d):
    """Suppliers of each customer's orders, repeats kept, and the brands in them, each once."""
    first = N.table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    second = N.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("b"), F.col("l_suppkey").cast("string").alias("c"))
    p = N.table(spark, d, "part")
    third = N.table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("b"), F.col("p_brand").alias("c"))
    got = labels.bags_and_sets(labels.two_hop(first, second), labels.two_hop(first, third))
    return got.select("a", F.concat_ws(" ", "venues").alias("venues"), F.concat_ws(" ", "topics").alias("topics"))


@query()
def topic_kmeans(spark, d):
    """Clusters of embeddings within each label, numbered on over labels."""
    e = N.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.pmod("label", F.lit(2)).alias("half"))
    return labels.topic_clusters(e, "half", 5)
