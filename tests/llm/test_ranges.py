import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm.ranges import range_cuts, run_of


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 1000])
def test_runs_equal_searchsorted(spark, n):
    rng = np.random.default_rng(n)
    cuts = np.unique(rng.integers(-500, 500, n))
    keys = [*range(-520, 520, 7), -(2**63), 2**63 - 1, *cuts.tolist()]
    got = spark.createDataFrame([(int(k),) for k in keys], "k long").select("k", run_of(F.col("k"), cuts).alias("run")).collect()
    assert [(r.k, r.run) for r in got] == [(k, int(np.searchsorted(cuts, k, "left"))) for k in keys]


def test_cuts_make_runs_of_like_length(spark):
    df = spark.range(4000).select((F.col("id") * 3 - 50).alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text")).repartition(5)
    rows, cuts = range_cuts(df, "doc_id", 20_000)
    assert rows == 4000 and len(cuts) == 19
    sizes = [r["count"] for r in df.groupBy(run_of(F.col("doc_id"), cuts).alias("run")).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 260
    rows, cuts = range_cuts(df.limit(0), "doc_id", 20_000)
    assert rows == 0 and len(cuts) == 0
    same = df.withColumn("doc_id", F.lit(7).cast("long"))
    assert len(range_cuts(same, "doc_id", 20_000)[1]) <= 1
