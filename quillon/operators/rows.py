"""Rows that fail to parse.

A file's header gives a schema (delimiter, columns, target table); each schema gives one anchored pattern for whole
rows. Rows that match it are valid. The rest pass through field-prefix patterns, one more field at a time, up to the first
field that breaks; where it lies and what follows it gives the reason. Rows are grouped by their file's pattern, so that one pattern serves many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.fields import SIMPLE, SIMPLE_P, acceptable, field_pattern, number, split_fields, trim_blank
from quillon.session import table

#: Columns with numbers, by target table; True: a probability.
TYPED = {"figure_7_summary": {"mean": False, "p_value": True}, "figure_6_field_measurements": {"value": False}}
DELIMITERS = (",", ";", "\t")


def _latest(rows: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """One row per row_id, the latest; of equal ones the greatest, so that row order doesn't matter."""
    return rows.where("row_id is not null").groupBy("row_id").agg(F.max(F.struct(order, *cols)).alias("r")).select("row_id", *[f"r.{c}" for c in cols])


def file_schemas(raw: DataFrame) -> DataFrame:
    """(package_root, figure_file, target, delimiter, columns, row_pattern) of every file with a header."""
    header = (
        raw.where("line_no = 1").groupBy("package_root", "figure_file")
        .agg(F.max(F.struct("received_at", "source_table", "line")).alias("h")).select("package_root", "figure_file", "h.source_table", "h.line")
    )
    line = F.regexp_replace(F.regexp_replace(F.coalesce("line", F.lit("")), "^﻿", ""), "\r$", "")
    counts = [F.struct(F.size(F.split(F.col("bare"), d)).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    found = (
        header.select("package_root", "figure_file", F.lower(F.trim("source_table")).alias("target"), line.alias("line"))
        .withColumn("bare", F.regexp_replace("line", '"[^"]*"', ""))
        .withColumn("delimiter", F.greatest(*counts)["d"])
        .withColumn("columns", F.transform(split_fields(F.col("line"), F.col("delimiter")), lambda c: F.lower(trim_blank(c))))
    )
    any_field = field_pattern(F.col("delimiter"))

    def pattern(c: Column) -> Column:
        p = any_field
        for target, typed in TYPED.items():
            for name, probability in typed.items():
                simple = SIMPLE_P if probability else SIMPLE
                p = F.when((F.col("target") == target) & (c == name), F.lit(f'(?:"{simple}"|{simple})')).otherwise(p)
        return p

    whole = F.concat(F.lit("^"), F.call_function("array_join", F.transform("columns", pattern), F.col("delimiter")), F.lit("$(?!\n)"))
    return found.select("package_root", "figure_file", "target", "delimiter", "columns", whole.alias("row_pattern"))


def check_rows(raw: DataFrame) -> DataFrame:
    """(row_id, package_root, figure_file, line_no, target, columns, fields, reason, broken_field) of every data row.

    ``reason`` is null for a valid row, else broken_quoting, column_count or invalid_value, the first that applies.
    ``broken_field`` counts from 1; one past the last column means that fields are left over. A null line is an
    empty line, which has one field. Rows of a file without header have one column of no known type.
    """
    data = _latest(raw, "received_at", ["package_root", "figure_file", "line_no", "line"]).where("line_no is null or line_no <> 1")
    s = file_schemas(raw)
    rows = data.join(s, ["package_root", "figure_file"], "left").withColumn("line", F.regexp_replace(F.coalesce("line", F.lit("")), "\r$", ""))
    rows = rows.withColumn("delimiter", F.coalesce("delimiter", F.lit(","))).withColumn("columns", F.coalesce("columns", F.array(F.lit(""))))
    valid = F.coalesce(F.expr("line rlike row_pattern"), F.lit(False))
    field = field_pattern(F.col("delimiter"))
    d, n = F.col("delimiter"), F.size("columns")
    well_formed = F.rlike("line", F.concat(F.lit("^"), field, F.lit("(?:"), d, field, F.lit(")*+$(?!\n)")))
    rows = rows.withColumn("valid", valid)

    def prefix(k: Column) -> Column:
        more = F.concat(F.lit("(?:"), d, field, F.lit("){"), (k - 1).cast("string"), F.lit("}"))
        return F.concat(F.lit("^"), field, more, F.lit("(?="), d, F.lit("|$(?!\n))"))

    stands = F.transform(F.sequence(F.lit(1), n), lambda k: F.rlike(F.col("line"), prefix(k)))
    first = F.array_position(stands, False).cast("int")  # 0: all of the header's fields stand
    rows = rows.withColumn("first_bad", F.when(F.col("valid"), 0).otherwise(first))
    rows = rows.withColumn("quoted_well", F.when(F.col("valid"), True).otherwise(well_formed))
    rows = rows.withColumn("fields", F.when(F.col("quoted_well"), split_fields(F.col("line"), d)))
    good = F.lit(True)
    bad_at = F.lit(None).cast("int")
    for target, typed in TYPED.items():
        for name, probability in typed.items():
            at = F.array_position("columns", name).cast("int")
            ok = ~((F.col("target") == target) & (at > 0)) | acceptable(F.get(F.col("fields"), at - 1), probability)
            ok = F.coalesce(ok, F.lit(True))
            good, bad_at = good & ok, F.least(bad_at, F.when(~ok, at))
    # A field that breaks though the row is well formed isn't there: the row ends before it.
    broken_at = F.when(F.col("quoted_well"), "column_count").otherwise("broken_quoting")
    reason = (
        F.when(F.col("valid"), None).when((F.col("first_bad") > 0) | ~F.col("quoted_well") | (F.size("fields") != n), broken_at).when(~good, "invalid_value")
    )
    broken = F.when(F.col("reason") == "invalid_value", bad_at).when(F.col("reason").isNotNull(), F.when(F.col("first_bad") == 0, n + 1).otherwise(F.col("first_bad")))
    return rows.withColumn("reason", reason).withColumn("broken_field", broken).select(
        "row_id", "package_root", "figure_file", "line_no", "target", "columns", "fields", "reason", "broken_field"
    )


def typed_rows(checked: DataFrame) -> DataFrame:
    """The valid rows: (row_id, package_root, figure_file, target, values map, numbers map of the typed columns)."""
    names = sorted({n for typed in TYPED.values() for n in typed})
    numbers = F.map_filter(F.map_from_arrays("columns", "fields"), lambda k, v: k.isin(*names))
    return checked.where("reason is null").select(
        "row_id", "package_root", "figure_file", "target", F.map_from_arrays("columns", "fields").alias("values"),
        F.transform_values(numbers, lambda k, v: number(trim_blank(v))).alias("numbers"),
    )


def bad_values(df: DataFrame, typed: dict[str, bool]) -> DataFrame:
    """(row_id, reason) of the rows of an all-string table in which a typed column can't be loaded."""
    rows = _latest(df, "ingested_at", list(typed))
    good = F.lit(True)
    for name, probability in typed.items():
        good = good & acceptable(F.col(name), probability)
    return rows.where(~good).select("row_id", F.lit("invalid_value").alias("reason"))


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("src_table"), F.col("row_id").cast("bigint").alias("row_id"), "reason")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _named(check_rows(table(spark, sf_dir, "raw_source_rows")).where("reason is not null"), "raw_source_rows")
    for name, typed in TYPED.items():
        out = out.unionByName(_named(bad_values(table(spark, sf_dir, name), typed), name))
    return out


def p4_broken_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first broken field of each row that can't be loaded, by number and name; one past the last column has no name."""
    bad = check_rows(table(spark, sf_dir, "raw_source_rows")).where("reason is not null")
    return bad.select(F.col("row_id").cast("bigint").alias("row_id"), "reason", F.col("broken_field").cast("bigint").alias("broken_field"), F.get("columns", F.col("broken_field") - 1).alias("column_name"))


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows of raw_source_rows with their typed numbers."""
    rows = typed_rows(check_rows(table(spark, sf_dir, "raw_source_rows")))
    get = lambda c: F.round(F.try_element_at("numbers", F.lit(c)), 9).alias(c)
    return rows.select(F.col("row_id").cast("bigint").alias("row_id"), "target", get("mean"), get("p_value"), get("value"))
