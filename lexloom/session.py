"""Spark session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Session settings every entry point uses. Partition counts are left to AQE.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "lexloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``.

    Where that setting is absent, a temporary folder of this machine serves a local master (tests); on a
    cluster, whose executors don't share it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "_own", None)
    if own is None:
        own = shared_dir._own = "file://" + tempfile.mkdtemp(prefix="lexloom-")
    return own


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs at most the tasks it was running.
    The table is removed when the driver ends, or by ``unstage``.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove a table of ``staged`` that nothing will read any more."""
    remove(df.sparkSession, df._staged)


def numbered(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """``df`` with its place in the order of the given columns, from 0, without sending all rows to one task:
    rows are sorted in ranges, each range numbers its own, and the few ranges' sizes give where each begins."""
    n_ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = df.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
    local = staged(sorted_rows.withColumns({"__range": F.spark_partition_id(), "__nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = local.groupBy("__range").agg(F.count("*").alias("n"))
    begins = sizes.withColumn("__begin", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return local.join(F.broadcast(begins), "__range").withColumn(name, F.col("__begin") + F.col("__nth")).drop("__range", "__nth", "__begin")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as a DataFrame."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
