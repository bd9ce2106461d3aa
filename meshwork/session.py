"""Session helpers: shared storage, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few fixed-width columns that may be broadcast (about 16 MB as a hash table).
BROADCAST_ROWS = 200_000

#: Rows of a few numbers that the driver holds of one table in a loop.
LOCAL_ROWS = 20_000

#: Rows of a file where the number of rows is known beforehand: of documents or what comes of them, and of a few numbers.
TEXT_ROWS, NUMBER_ROWS = 20_000, 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is absent and all run in one local JVM, as in tests, a
    temporary folder is made, once per Spark context; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="meshwork-")
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def files_for(rows: int, each: int = TEXT_ROWS) -> int:
    """Files for so many rows."""
    return max(1, -(-rows // each))


def materialize(df: DataFrame, name: str = "t", files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with replicated, executor-independent files, so that a lost
    executor costs no recomputation of what came before. ``files`` bounds the number
    of tasks that write, so that small tables aren't dealt out into many small files.
    """
    df = df if files is None else df.coalesce(files)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshwork/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def settle(df: DataFrame, name: str = "t", guess: int = 0) -> tuple[DataFrame, int]:
    """``df`` evaluated once, and its rows: up to LOCAL_ROWS rows are held by the driver as a local relation, more are written.

    For the many small tables of a loop over frontiers. A ``guess`` of more rows is
    written at once; a wrong one costs an evaluation that ends at LOCAL_ROWS rows.
    """
    spark = df.sparkSession
    if guess <= LOCAL_ROWS:
        table = df.limit(LOCAL_ROWS + 1).toArrow()
        if table.num_rows <= LOCAL_ROWS:
            return (spark.createDataFrame(table, df.schema) if table.num_rows else spark.createDataFrame([], df.schema)), table.num_rows
    df = materialize(df, name)
    return df, df.count()


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a frame made by :func:`materialize`."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    files = df.inputFiles()
    if files:
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if "/meshwork/" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint where ``df`` (materialised, narrow) has at most ``rows`` rows.

    Larger frames come back as they are: the join then shuffles both sides.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
