"""What changed between full snapshots.

The listings are written once, parted by snapshot and bucketed by a key of package and path. A bucketed index holds the key and
hash of every file of each package's last snapshot. A new snapshot is probed against it bucket by bucket (both sides are bucketed
alike, so neither is exchanged); the probe's result, written bucket by bucket again, takes the old index's place. Values other
than the hash are fetched from the listings for the changed keys alone.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.paths import normal_path, strip
from quillon.session import bucketed, drop_table, materialise, table

#: Packages whose numbers are broadcast at most, some 100 bytes each; more of them are joined with an exchange.
BROADCAST_PACKAGES = 200_000
KEY = ["key", "package_root", "path"]
CHANGE = "package_root string, path string, change_kind string, old_hash string, new_hash string, key bigint, snapshot_no bigint"


def listing(manifest: DataFrame) -> DataFrame:
    """One row per package, snapshot and normalised path: (package_root, snapshot_no, path, hash, size).

    Of several listings the latest ``received_at`` counts, a null one last; of equal ones the greatest hash, then size, so that
    the result doesn't depend on row order. A null or blank hash is unknown (null). Rows without package, snapshot
    number or path name no file and are dropped. Other columns are ignored.
    """
    hashed = F.lower(strip(F.col("sha256")))
    size = F.col("size_bytes") if "size_bytes" in manifest.columns else F.lit(None)
    latest = F.max(F.struct(F.col("received_at"), F.when(hashed != "", hashed).alias("hash"), F.col("size")))
    return (
        manifest.where("package_root is not null and snapshot_no is not null and path is not null")
        .select("package_root", F.col("snapshot_no").cast("bigint").alias("snapshot_no"), normal_path(F.col("path")).alias("path"), "sha256", "received_at", size.cast("bigint").alias("size"))
        .groupBy("package_root", "snapshot_no", "path")
        .agg(latest.alias("latest"))
        .select("package_root", "snapshot_no", "path", "latest.hash", "latest.size")
    )


@contextmanager
def _bucket_joins(spark: SparkSession):
    """Joins on more columns than the bucket's need no exchange within."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class SnapshotIndex:
    """The index of the last snapshots: a table (key, package_root, path, hash) bucketed by key."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.name: str | None = None
        self.rows: DataFrame | None = None

    def apply(self, snapshot: DataFrame, packages: DataFrame, small: bool = False) -> DataFrame:
        """Probe with one snapshot (key, package_root, path, hash) and swap the index.

        ``packages`` has (package_root, first) for each package that is in the snapshot; ``first`` means that the
        package has no earlier one; ``small`` that they may be broadcast. Returns (key, package_root, path, change_kind, old_hash, new_hash) of the
        changed files. Packages that the snapshot doesn't hold keep their index.
        """
        new = snapshot.select(*KEY, F.col("hash").alias("new_hash"))
        known = F.broadcast(packages) if small else packages
        if self.rows is None:
            old = self.spark.createDataFrame([], "key bigint, package_root string, path string, old_hash string")
        else:
            old = self.rows.select(*KEY, F.col("hash").alias("old_hash"))
        here = new.join(old.withColumn("in_old", F.lit(True)), KEY, "left").join(known, "package_root")
        kind = F.when(F.col("first"), None).when(F.col("in_old").isNull(), "added").when(F.col("new_hash") != F.col("old_hash"), "changed")
        kept = here.select(*KEY, F.col("new_hash").alias("hash"), kind.alias("change_kind"), "old_hash", "new_hash")
        lacking = old.join(new.select(*KEY), KEY, "left_anti").join(known, "package_root", "left")
        none = F.lit(None).cast("string")
        gone = lacking.select(*KEY, F.col("old_hash").alias("hash"), F.when(F.col("first").isNotNull(), "removed").alias("change_kind"), "old_hash", none.alias("new_hash"))
        before = self.name
        with _bucket_joins(self.spark):
            self.name, rows = bucketed(kept.unionByName(gone), "index", "key", self.buckets, exchange=False)
        self.rows = rows.where("change_kind is null or change_kind <> 'removed'")
        if before:
            drop_table(self.spark, before)  # its files stay until the changes in them have been read
        return rows.where("change_kind is not null").select(*KEY, "change_kind", "old_hash", "new_hash")


def snapshot_changes(manifest: DataFrame, buckets: int | None = None, sizes: bool = False, baseline: bool = False) -> DataFrame:
    """(package_root, snapshot_no, path, change_kind, old_hash, new_hash) of every change between a package's consecutive snapshots.

    ``snapshot_no`` is the later one; kinds are added, removed and changed (both hashes known and different). The
    first snapshot of a package gives no rows; an empty table gives none. With ``sizes`` old_size and new_size are fetched too;
    with ``baseline`` the files of a package's first snapshot count as added.
    """
    spark = manifest.sparkSession
    files = listing(manifest).withColumn("key", F.xxhash64("package_root", "path"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _, values = bucketed(files, "listing", "key", buckets, partition_by="snapshot_no")
    numbered = values.groupBy("package_root", "snapshot_no").agg(F.count("*").alias("files"))
    packages = materialise(numbered.groupBy("package_root").agg(F.array_sort(F.collect_list("snapshot_no")).alias("nos")), "packages")
    small = packages.count() <= BROADCAST_PACKAGES
    numbers = [r[0] for r in packages.select(F.explode("nos").alias("no")).distinct().orderBy("no").collect()]  # one per delivery
    index, out = SnapshotIndex(spark, buckets), []
    for no in numbers:
        here = packages.where(F.array_contains("nos", F.lit(no).cast("bigint"))).select("package_root", (F.lit(False) if baseline else F.col("nos")[0] == no).alias("first"))
        changes = index.apply(values.where(F.col("snapshot_no") == no), here, small)
        out.append(changes.select("package_root", "path", "change_kind", "old_hash", "new_hash", "key", F.lit(no).cast("bigint").alias("snapshot_no")))
    changed = spark.createDataFrame([], CHANGE) if not out else out[0]
    for more in out[1:]:
        changed = changed.unionByName(more)
    columns = ["package_root", "snapshot_no", "path", "change_kind", "old_hash", "new_hash"]
    return _with_sizes(changed, values, packages).select(*columns, "old_size", "new_size") if sizes else changed.select(*columns)


def _with_sizes(changed: DataFrame, values: DataFrame, packages: DataFrame) -> DataFrame:
    """The changes with the sizes of both ends, looked up for their keys alone."""
    at = F.array_position("nos", F.col("snapshot_no")).cast("int")
    ends = changed.join(packages, "package_root").withColumn("before_no", F.col("nos")[at - 2]).drop("nos")
    size = lambda no, name: values.select(*KEY, F.col("snapshot_no").alias(no), F.col("size").alias(name))
    return ends.join(size("before_no", "old_size"), [*KEY, "before_no"], "left").join(size("snapshot_no", "new_size"), [*KEY, "snapshot_no"], "left")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "file_hash_manifest")).select("package_root", "snapshot_no", "path", "change_kind")


def p3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes with old and new hash and size."""
    return snapshot_changes(table(spark, sf_dir, "file_hash_manifest"), sizes=True)
