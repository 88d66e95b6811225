"""Session, table and shared-storage helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process wrote into the shared folder, for clean().
_PATHS: list[str] = []
_TABLES: list[str] = []


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer tasks than that, for work that is heavy per row; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset a local session, whose executors are one machine, gets a temporary one; a cluster gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, buckets: int, partition_by: str | None = None, exchange: bool = True) -> tuple[str, DataFrame]:
    """Write ``df`` as a table bucketed by ``key`` into the shared folder; its name and its contents.

    Joins of two such tables on ``key`` need no exchange. ``exchange`` False writes rows where they are: right where each task holds one bucket's.
    """
    spark = df.sparkSession
    name = f"quillon_{label}_{uuid.uuid4().hex}"
    writer = (df.repartition(buckets, key) if exchange else df).write.bucketBy(buckets, key).sortBy(key)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.option("path", scratch_path(spark, label)).option("compression", "zstd").format("parquet").saveAsTable(name)
    _TABLES.append(name)
    return name, spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop an external table; its files stay."""
    spark.sql(f"drop table if exists {name}")
    if name in _TABLES:
        _TABLES.remove(name)


def clean(spark: SparkSession) -> int:
    """Delete the intermediate tables and files that this process wrote; how many there were.

    To be called when results have been written: DataFrames returned before may read those files.
    """
    n = len(_PATHS)
    while _TABLES:
        drop_table(spark, _TABLES[-1])
    while _PATHS:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return n
