"""Where long lineages are cut: a folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local session without one gets a temporary folder, a cluster must name one."""
    here = spark.conf.get("spark.checkpoint.dir", None)
    if here is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stratagraph-")
        atexit.register(shutil.rmtree, folder, True)
        here = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", here)
        spark.sparkContext.setCheckpointDir(here)
    return here


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's plain path in the shared folder, for files that Python writes and maps; ValueError if it isn't mounted as files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    at = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if at.getScheme() != "file":
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder to write {name}, not {at.getScheme()}:")
    return at.getPath()


#: Whether a query's shuffle files go when it ends, or when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Tables written here leave no shuffle files behind: what is written needs them no longer."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def materialise(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """df as a table in the shared folder: what reads it needs no executor that made it. level: of compression."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _cleaned(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``materialise`` in buckets by key, as many as a shuffle has partitions: joins and aggregates by key read it without a shuffle."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _cleaned(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{table}").option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def running(df: DataFrame, order: list, amount: str | None = None, name: str = "before") -> DataFrame:
    """df with the sum of an amount (1 without) over the rows before each in a total order of all of them; ties stand in any order.

    Rows are put into ranges of the order, each range is summed by itself, and the ranges' totals, a row for each, are added: no task
    has all rows.
    """
    spark = df.sparkSession
    one = F.lit(1) if amount is None else F.col(amount)
    ranged = materialise(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("__range").agg(F.sum(one).alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(upto), F.lit(0))).drop("__sum")
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(base), "__range")  # a row for each range
    return out.withColumn(name, F.col("__base") + F.coalesce(F.sum(one).over(own), F.lit(0))).drop("__range", "__base")
