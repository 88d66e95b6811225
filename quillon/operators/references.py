"""References to records that do not exist.

References and existing keys are turned into signed deltas per key and snapshot, summed before any window (so a key
named by a third of all rows becomes one row per snapshot first), and accumulated in snapshot order. A key with
references and without existence in a snapshot is an orphan there. ReferenceCounts keeps the two counts of each key in a
table and takes one delivery's deltas at a time; orphan_references() accumulates those of the whole history at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.paths import base_name, normal_path, references
from quillon.operators.snapshots import snapshot_changes
from quillon.session import materialise, table

#: Reference fields by table.
FIELDS = {"claim_manifest": ("source_data", "raw_record"), "assembly_manifest": ("figure_panel", "source_record")}


def reference_rows(tables: dict[str, DataFrame], fields: dict[str, tuple[str, ...]] = FIELDS) -> DataFrame:
    """Distinct (src_table, row_id, package_root, snapshot_no, ref_field, ref_path, period).

    Rows delivered twice count once; where the deliveries differ, the latest ``ingested_at`` counts. ``period`` is the
    month of ``created_at`` (null if that is null). Rows without a row_id, package or snapshot number name nothing.
    """
    out = None
    for name, df in tables.items():
        cols = ["package_root", "snapshot_no", "created_at", *fields[name]]
        rows = df.where("row_id is not null").groupBy("row_id").agg(F.max(F.struct("ingested_at", *cols)).alias("r")).select("row_id", "r.*")
        fields_of = F.array(*[F.struct(F.lit(f).alias("ref_field"), references(F.col(f)).alias("paths")) for f in fields[name]])
        part = (
            rows.where("package_root is not null and snapshot_no is not null")
            .withColumn("f", F.explode(fields_of))
            .select(
                F.lit(name).alias("src_table"), F.col("row_id").cast("bigint").alias("row_id"), "package_root",
                F.col("snapshot_no").cast("bigint").alias("snapshot_no"), F.col("f.ref_field").alias("ref_field"),
                F.explode(F.array_distinct(F.col("f.paths"))).alias("ref_path"), F.date_format("created_at", "yyyy-MM").alias("period"),
            )
        )
        out = part if out is None else out.unionByName(part)
    return out


def existence_deltas(manifest: DataFrame) -> DataFrame:
    """(package_root, ref_key, snapshot_no, exist): +1 where a run of consecutive snapshots holding the key starts, -1 after its end.

    A key is a full path or the file name alone; a snapshot that a package lacks lists nothing.
    """
    path = normal_path(F.col("path"))
    listed = (
        manifest.where("package_root is not null and snapshot_no is not null and path is not null")
        .select("package_root", F.col("snapshot_no").cast("bigint").alias("snapshot_no"), path.alias("path"))
        .withColumn("ref_key", F.explode(F.array_distinct(F.array(F.col("path"), base_name(F.col("path"))))))
        .groupBy("package_root", "ref_key", "snapshot_no").agg(F.lit(1).alias("one"))
    )
    edges = F.explode(F.array(F.struct(F.col("snapshot_no").alias("at"), F.lit(1).alias("d")), F.struct((F.col("snapshot_no") + 1).alias("at"), F.lit(-1).alias("d"))))
    return (
        listed.select("package_root", "ref_key", edges.alias("e"))
        .groupBy("package_root", "ref_key", F.col("e.at").alias("snapshot_no"))
        .agg(F.sum("e.d").cast("bigint").alias("exist"))
        .where("exist <> 0")
    )


def reference_deltas(refs: DataFrame) -> DataFrame:
    """(package_root, ref_key, snapshot_no, refs): +n in the snapshot the references were written against, -n after it."""
    edges = F.explode(F.array(F.struct(F.col("snapshot_no").alias("at"), F.lit(1).alias("d")), F.struct((F.col("snapshot_no") + 1).alias("at"), F.lit(-1).alias("d"))))
    counted = refs.groupBy("package_root", F.col("ref_path").alias("ref_key"), "snapshot_no").agg(F.count("*").alias("n"))
    return (
        counted.select("package_root", "ref_key", "n", edges.alias("e"))
        .groupBy("package_root", "ref_key", F.col("e.at").alias("snapshot_no"))
        .agg(F.sum(F.col("e.d") * F.col("n")).alias("refs"))
        .where("refs <> 0")
    )


def orphan_keys(existence: DataFrame, reference: DataFrame) -> DataFrame:
    """(package_root, ref_key, snapshot_no, orphan_kind): keys with references and no existence, in each such snapshot.

    The windows hold at most two rows per snapshot of a key. ``deleted``: it existed in an earlier snapshot; else
    ``late``: it exists in a later one; else ``missing``.
    """
    zero = F.lit(0).cast("bigint")
    deltas = existence.withColumn("refs", zero).unionByName(reference.withColumn("exist", zero))
    summed = deltas.groupBy("package_root", "ref_key", "snapshot_no").agg(F.sum("exist").alias("exist"), F.sum("refs").alias("refs"), F.max(F.expr("exist > 0")).alias("starts"))
    key = Window.partitionBy("package_root", "ref_key").orderBy("snapshot_no")
    ahead = key.rowsBetween(1, Window.unboundedFollowing)
    state = summed.select(
        "package_root", "ref_key", "snapshot_no",
        F.sum("exist").over(key.rowsBetween(Window.unboundedPreceding, 0)).alias("existing"),
        F.sum("refs").over(key.rowsBetween(Window.unboundedPreceding, 0)).alias("referring"),
        F.max("starts").over(key.rowsBetween(Window.unboundedPreceding, 0)).alias("before"),
        F.max("starts").over(ahead).alias("after"),
        F.coalesce(F.lead("snapshot_no").over(key), F.col("snapshot_no") + 1).alias("until"),
    )
    kind = F.when(F.col("before"), "deleted").when(F.col("after"), "late").otherwise("missing")
    return state.where("referring > 0 and existing = 0").select(
        "package_root", "ref_key", F.explode(F.sequence(F.col("snapshot_no"), F.col("until") - 1)).alias("snapshot_no"), kind.alias("orphan_kind")
    )


def orphan_references(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """(src_table, row_id, ref_field, ref_path, orphan_kind, period): every reference that its own snapshot doesn't list."""
    refs = reference_rows(tables)
    orphans = orphan_keys(existence_deltas(manifest), reference_deltas(refs)).withColumnRenamed("ref_key", "ref_path")
    found = refs.join(orphans, ["package_root", "ref_path", "snapshot_no"])
    return found.select("src_table", "row_id", "ref_field", "ref_path", "orphan_kind", "period")


class ReferenceCounts:
    """Signed reference and existence counts per key, kept in a table (package_root, ref_key, exist, refs) and updated from deltas."""

    def __init__(self, spark: SparkSession):
        self.rows = spark.createDataFrame([], "package_root string, ref_key string, exist bigint, refs bigint")

    def apply(self, existence: DataFrame, reference: DataFrame) -> DataFrame:
        """Add deltas (package_root, ref_key, exist) and (package_root, ref_key, refs); the orphans (package_root, ref_key, refs) of the new state."""
        zero = F.lit(0).cast("bigint")
        deltas = existence.select("package_root", "ref_key", "exist", zero.alias("refs")).unionByName(reference.select("package_root", "ref_key", zero.alias("exist"), "refs"))
        summed = self.rows.unionByName(deltas).groupBy("package_root", "ref_key").agg(F.sum("exist").alias("exist"), F.sum("refs").alias("refs"))
        self.rows = materialise(summed.where("exist <> 0 or refs <> 0"), "counts")
        return self.rows.where("refs > 0 and exist <= 0").select("package_root", "ref_key", "refs")


def existence_changes(changes: DataFrame) -> DataFrame:
    """(package_root, ref_key, snapshot_no, exist) of snapshot changes: files added to less files removed from each full path and file name."""
    keys = F.explode(F.array_distinct(F.array(F.col("path"), base_name(F.col("path"))))).alias("ref_key")
    signed = F.when(F.col("change_kind") == "added", 1).otherwise(-1).alias("d")
    rows = changes.where("change_kind <> 'changed'").select("package_root", "snapshot_no", keys, signed)
    return rows.groupBy("package_root", "ref_key", "snapshot_no").agg(F.sum("d").alias("exist")).where("exist <> 0")


def current_orphans(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """(package_root, ref_path, n_refs): references written against the last snapshot of their package that it doesn't list.

    Delivery by delivery the counts take the files that came and went, and the references of the packages it lists in place of those
    of their listing before.
    """
    spark = manifest.sparkSession
    changes = materialise(existence_changes(snapshot_changes(manifest, baseline=True)), "existence")
    listed = manifest.where("package_root is not null and snapshot_no is not null and path is not null").select("package_root", F.col("snapshot_no").cast("bigint").alias("no")).distinct()
    nos = listed.groupBy("package_root").agg(F.array_sort(F.collect_list("no")).alias("nos"))
    counted = reference_rows(tables).groupBy("package_root", F.col("ref_path").alias("ref_key"), "snapshot_no").agg(F.count("*").alias("n"))
    at = F.array_position("nos", F.col("snapshot_no")).cast("int")
    ends = F.explode(F.array(F.struct(F.col("snapshot_no").alias("no"), F.col("n").alias("refs")), F.struct(F.get("nos", at).alias("no"), (-F.col("n")).alias("refs")))).alias("e")
    signed = counted.join(nos, "package_root").where(at > 0).select("package_root", "ref_key", ends).select("package_root", "ref_key", "e.no", "e.refs").where("no is not null")
    signed = materialise(signed.groupBy("package_root", "ref_key", "no").agg(F.sum("refs").alias("refs")), "references")
    counts = ReferenceCounts(spark)
    orphans = spark.createDataFrame([], "package_root string, ref_key string, refs bigint")
    for no in [r[0] for r in listed.select("no").distinct().orderBy("no").collect()]:  # one per delivery
        orphans = counts.apply(changes.where(F.col("snapshot_no") == no), signed.where(F.col("no") == no))
    return orphans.select("package_root", F.col("ref_key").alias("ref_path"), F.col("refs").alias("n_refs"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table and month, by kind."""
    return orphans.groupBy("src_table", "period", "orphan_kind").agg(F.count("*").alias("n_orphans"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: table(spark, sf_dir, name) for name in FIELDS}
    return orphan_references(tables, table(spark, sf_dir, "file_hash_manifest"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).drop("period")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(_orphans(spark, sf_dir))


def p6_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of each package's last snapshot, from counts that are updated by its changes."""
    return current_orphans({name: table(spark, sf_dir, name) for name in FIELDS}, table(spark, sf_dir, "file_hash_manifest"))
