"""Statistical consistency and digit screens over source tables.

``cells`` are (table_id, col, row_idx, raw) with text values; every screen is one aggregation over them. Screens give
a row per screened group with its figures and ``flagged``, so that what was looked at is seen too.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import numbers as N

MIN_DIGITS, MIN_BENFORD, MIN_P_VALUES, MIN_COUNT_N = 8, 30, 20, 6


def melt(df: DataFrame, table_id: Column, row_idx: Column, columns: list[str]) -> DataFrame:
    """(table_id, row_idx, col, col_pos, raw) of a wide table, values as text."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(i).alias("col_pos"), F.col(c).cast("string").alias("raw")) for i, c in enumerate(columns)]))
    return df.select(table_id.alias("table_id"), row_idx.alias("row_idx"), cells.alias("c")).select("table_id", "row_idx", "c.col", "c.col_pos", "c.raw")


def format_profiles(cells: DataFrame) -> DataFrame:
    """(table_id, col, profile) of the columns with a value of a known format."""
    kind = F.when(F.col("raw").isNotNull(), N.format_kind(F.col("raw")))
    return cells.groupBy("table_id", "col").agg(N.column_profile(kind).alias("profile")).where("profile is not null")


def numeric_cells(cells: DataFrame) -> DataFrame:
    """Cells with a number: (table_id, row_idx, col, col_pos, text, value); the column's format decides how text is read."""
    c = cells.join(format_profiles(cells), ["table_id", "col"], "left")
    raw, profile = F.col("raw"), F.col("profile")
    text, value = N.normal_number_text(raw, profile), N.parse_number(raw, profile)
    return c.select("table_id", "row_idx", "col", "col_pos", text.alias("text"), value.alias("value")).where("value is not null")


def format_gaps(cells: DataFrame) -> DataFrame:
    """(table_id, col, profile, n_gaps, examples): comma values that the column's format leaves unread, with the first five."""
    c = cells.join(format_profiles(cells), ["table_id", "col"])
    bad = c.where(N.raw_numeric_text(F.col("raw")).contains(",") & N.parse_number(F.col("raw"), F.col("profile")).isNull())
    w = Window.partitionBy("table_id", "col").orderBy("row_idx")
    n = F.count("*").over(Window.partitionBy("table_id", "col"))
    top = bad.withColumn("k", F.row_number().over(w)).withColumn("n_gaps", n).where("k <= 5")
    return top.groupBy("table_id", "col", "profile", "n_gaps").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "raw"))), lambda x: x["raw"]), " | ").alias("examples"))


def summary_rows(df: DataFrame, table_id: Column, key: str) -> DataFrame:
    """mean, sd, sem, n, p as numbers and normal text, per row, read in their columns' formats."""
    names = ["mean", "sd", "sem", "n", "p_value"]
    cells = melt(df, table_id, F.col(key), names)
    wide = df.withColumn("table_id", table_id)
    profiles = format_profiles(cells).groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "profile"))).alias("p"))
    wide = wide.join(profiles, "table_id", "left")
    of = lambda c: F.try_element_at("p", F.lit(c))
    return wide.select(
        "table_id", F.col(key).alias("row_idx"),
        *[N.parse_number(F.col(c), of(c)).alias(c) for c in names],
        *[N.normal_number_text(F.col(c), of(c)).alias(f"{c}_text") for c in names],
    )


def check_summaries(rows: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(table_id, row_idx, check, level): each contradiction within a summary row."""
    n, sd, sem, mean, p = (F.col(c) for c in ("n", "sd", "sem", "mean", "p_value"))
    expected = sem * F.sqrt(n)
    base = F.greatest(F.lit(tolerance), F.abs(expected) * tolerance)
    precise = N.half_ulp(F.col("sd_text"), tolerance) + F.sqrt(n) * N.half_ulp(F.col("sem_text"), tolerance)
    checks = [
        ("n_not_a_count", "R2", (n <= 0) | (F.abs(n - F.bround(n)) > 1e-9)),
        ("sd_negative", "R3", sd < 0),
        ("sem_negative", "R3", sem < 0),
        ("sd_sem_mismatch", "R2", (n > 1) & (F.abs(sd - expected) > F.greatest(base, precise))),
        ("sd_equals_sem", "R2", (n > 2) & (F.abs(sd - sem) <= base)),
        ("p_out_of_range", "R3", (p < 0) | (p > 1)),
        ("tiny_relative_sd", "R1", (F.abs(mean) > 0) & (sd / F.abs(mean) < 1e-6)),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("check"), F.lit(lv).alias("level"))) for k, lv, c in checks]), lambda x: x.isNotNull())
    return rows.select("table_id", "row_idx", F.explode(found).alias("f")).select("table_id", "row_idx", "f.check", "f.level")


def integer_counts(rows: DataFrame, tolerance: float = 1e-3, min_n: int = MIN_COUNT_N) -> DataFrame:
    """(table_id, row_idx, issue): mean, SD and n that no set of integers can have; null issue if they can.

    Only rows with a finite mean and an integer n of at least ``min_n``. First the total must be an integer within reporting precision,
    then one of the possible totals must allow an integer sum of squares under the sample or population SD.
    """
    n, mean, sd = F.bround("n").alias("n"), F.col("mean"), F.col("sd")
    low, high = lambda x: F.greatest(F.lit(0.0), x - N.half_ulp(F.col("sd_text"), tolerance)), lambda x: x + N.half_ulp(F.col("sd_text"), tolerance)
    r = rows.where((F.abs(mean) < 1e15) & (F.col("n") > 0) & (F.col("n") < 1e15) & (F.abs(F.col("n") - F.bround("n")) <= tolerance) & (F.bround("n") >= min_n))
    r = r.select(
        "table_id", "row_idx", "sd", n, (mean * F.bround("n")).alias("total"), (N.half_ulp(F.col("mean_text"), tolerance) * F.bround("n")).alias("half"),
        low(sd).alias("lo"), high(sd).alias("hi"),
    )
    first, last = F.ceil(F.col("total") - F.col("half") - tolerance), F.floor(F.col("total") + F.col("half") + tolerance)
    r = r.withColumn("first", first).withColumn("last", last)

    def possible(t: Column) -> Column:
        square = t.cast("double") * t.cast("double") / F.col("n")
        of = lambda s, k: s * s * k + square
        a, b = of(F.col("lo"), F.col("n") - 1), of(F.col("hi"), F.col("n") - 1)
        c, d = of(F.col("lo"), F.col("n")), of(F.col("hi"), F.col("n"))
        relaxed = F.greatest(F.lit(0.02), tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b), F.abs(c), F.abs(d)))
        return N.range_has_integer(a, b, relaxed) | N.range_has_integer(c, d, relaxed)

    some = F.when(F.col("first") <= F.col("last"), F.exists(F.sequence("first", F.greatest("first", "last")), possible))
    issue = F.when(F.col("first") > F.col("last"), "total").when((F.col("sd") >= 0) & (F.col("n") > 1) & ~some, "sum_of_squares")
    return r.select("table_id", "row_idx", issue.alias("issue"))


def _by_text(cells: DataFrame) -> DataFrame:
    """(table_id, col, text, n, first): equal texts counted before any digit is looked at."""
    return cells.groupBy("table_id", "col", "text").agg(F.count("*").alias("n"), F.min("row_idx").alias("first"))


def _shares(cells: DataFrame, value: Column) -> DataFrame:
    """Per (table_id, col, value): n, first row; with the column's total."""
    valued = _by_text(cells).withColumn("v", value).where("v is not null")
    counted = valued.groupBy("table_id", "col", "v").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return counted.withColumn("total", F.sum("n").over(Window.partitionBy("table_id", "col")))


def terminal_digits(cells: DataFrame, dominance: float = 0.65, min_count: int = MIN_DIGITS) -> DataFrame:
    """(table_id, col, digit, n, total, share, flagged): the most frequent last digit, ties to the one met first."""
    s = _shares(cells.where("col <> 'n'"), N.terminal_of(F.col("text"))).where(F.col("total") >= min_count)
    top = s.groupBy("table_id", "col", "total").agg(F.max_by("v", F.struct("n", -F.col("first"), "v")).alias("digit"), F.max("n").alias("n"))
    share = F.col("n") / F.col("total")
    return top.select("table_id", "col", "digit", "n", "total", F.round(share, 6).alias("share"), (share >= dominance).alias("flagged"))


def rounding(cells: DataFrame, threshold: float = 0.85, min_count: int = MIN_DIGITS) -> DataFrame:
    """(table_id, col, total, share, flagged): share of values that end in 0 or 5."""
    d = _by_text(cells.where("col <> 'n'")).withColumn("d", N.terminal_of(F.col("text"))).where("d is not null")
    g = d.groupBy("table_id", "col").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("d").isin("0", "5"), F.col("n")).otherwise(0)).alias("k")).where(F.col("total") >= min_count)
    share = F.col("k") / F.col("total")
    return g.select("table_id", "col", "total", F.round(share, 6).alias("share"), (share >= threshold).alias("flagged"))


def precision_mix(cells: DataFrame, min_count: int = MIN_DIGITS) -> DataFrame:
    """(table_id, col, places, n_places, total, share, mixed, differs): the dominant number of decimals of a column.

    ``mixed``: several numbers of decimals, the dominant one with at most 0.8; ``differs``: the table's columns have several dominant ones.
    """
    s = _shares(cells.where("col <> 'n'"), N.places_of(F.col("text"))).where(F.col("total") >= min_count)
    top = s.groupBy("table_id", "col", "total").agg(F.max_by("v", F.struct("n", -F.col("first"), "v")).alias("places"), F.max("n").alias("n"), F.count("*").alias("n_places"))
    w = Window.partitionBy("table_id")
    share = F.col("n") / F.col("total")
    return top.select(
        "table_id", "col", "places", "n_places", "total", F.round(share, 6).alias("share"), ((F.col("n_places") > 1) & (share <= 0.8)).alias("mixed"),
        (F.min("places").over(w) != F.max("places").over(w)).alias("differs"),
    )


def benford(cells: DataFrame, threshold: float = 20.0, min_count: int = MIN_BENFORD) -> DataFrame:
    """(table_id, total, chi_square, flagged) of the first digits of all positive values outside summary columns."""
    d = N.first_significant_digit(F.col("value")).cast("int")
    c = cells.where(~F.col("col").isin(*N.SUMMARY_COLUMNS) & (F.col("value") > 0)).withColumn("d", d).where("d is not null")
    counts = [F.count_if(F.col("d") == k).alias(f"d{k}") for k in range(1, 10)]
    g = c.groupBy("table_id").agg(F.count("*").alias("total"), *counts).where(F.col("total") >= min_count)
    chi = F.lit(0.0)
    for k in range(1, 10):
        e = F.log10(F.lit(1 + 1 / k)) * F.col("total")
        chi = chi + (F.col(f"d{k}") - e) * (F.col(f"d{k}") - e) / e
    return g.select("table_id", "total", F.round(chi, 6).alias("chi_square"), (chi >= threshold).alias("flagged"))


def p_clusters(cells: DataFrame, window: float = 0.005, near: float = 0.35, repeated: float = 0.25, min_count: int = MIN_P_VALUES) -> DataFrame:
    """(table_id, col, total, near_share, repeated_text, repeat_share, flagged) of p-value columns."""
    h = N.normal_header(F.col("col"))
    p = cells.where((h.isin(*N.P_COLUMNS) | h.startswith("p_")) & F.col("value").between(0, 1))
    close = sum((F.count_if((F.col("value") >= t - window) & (F.col("value") < t)) for t in (0.05, 0.01, 0.001)), F.lit(0))
    per_text = p.groupBy("table_id", "col", "text").agg(F.count("*").alias("k"), F.min("row_idx").alias("first"), close.alias("near"))
    g = per_text.groupBy("table_id", "col").agg(
        F.sum("k").alias("total"), F.sum("near").alias("near"), F.max("k").alias("k"), F.max_by("text", F.struct("k", -F.col("first"), "text")).alias("repeated_text")
    ).where(F.col("total") >= min_count)
    a, b = F.col("near") / F.col("total"), F.col("k") / F.col("total")
    return g.select("table_id", "col", "total", F.round(a, 6).alias("near_share"), "repeated_text", F.round(b, 6).alias("repeat_share"), ((a >= near) | (b >= repeated)).alias("flagged"))


def repeated_summaries(rows: DataFrame) -> DataFrame:
    """(table_id, mean_text, sd_text, n_rows): equal mean and SD in two or more rows of a table."""
    g = rows.where("mean is not null and sd is not null").groupBy("table_id", "mean_text", "sd_text").agg(F.count("*").alias("n_rows"))
    return g.where("n_rows >= 2")


def column_pairs(wide: DataFrame, table_id: Column, row_idx: Column, columns: list[str]) -> DataFrame:
    """(table_id, left, right, row_idx, x, y, x_text, y_text): all pairs of numeric columns of a row, from the row itself (no join)."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"), F.col(a).cast("string").alias("x_text"), F.col(b).cast("string").alias("y_text"))
        for a, b in combinations(columns, 2)
    ]))
    out = wide.select(table_id.alias("table_id"), row_idx.alias("row_idx"), pairs.alias("p")).select("table_id", "row_idx", "p.*")
    return out.where("x is not null and y is not null")


def fits(pairs: DataFrame, min_pairs: int = 4) -> DataFrame:
    """Least squares of each pair: n, slope, intercept, r2, corr, scale and the greatest residual."""
    keys = ["table_id", "left", "right"]
    g = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("corr"),
        F.greatest(F.lit(1.0), F.max(F.abs("x")), F.max(F.abs("y"))).alias("scale"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"),
        F.approx_count_distinct("x", 0.02).alias("dx"), F.approx_count_distinct("y", 0.02).alias("dy"),
    ).where(F.col("n") >= max(3, min_pairs)).where("vx > 0 and vy > 0")
    residual = F.abs(F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept")))
    worst = pairs.join(g, keys).groupBy(*keys).agg(F.max(residual).alias("worst"))
    return g.join(worst, keys).withColumn("r2", F.col("corr") * F.col("corr"))


def _exact(tolerance: float) -> Column:
    return (F.col("r2") >= 0.999999) & (F.col("worst") <= tolerance * F.col("scale"))


def column_relations(pairs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(table_id, left, right, relation): exact linear relations by kind, else equal rank order, else high correlation.

    Pairs whose names have different time tokens and summary columns are left out. Ranks break ties by row; equal order counts
    only if all values differ. It is checked on neighbours in the order of one column, within a table.
    """
    lt, rt = N.time_token(F.col("left")), N.time_token(F.col("right"))
    wanted = ~F.col("left").isin(*N.SUMMARY_COLUMNS) & ~F.col("right").isin(*N.SUMMARY_COLUMNS) & (lt.isNull() | rt.isNull() | (lt == rt))
    keys = ["table_id", "left", "right"]
    f = fits(pairs).where(wanted)  # names are looked at once per pair of columns, not per row
    w = Window.partitionBy(*keys).orderBy("x", "row_idx")
    rises = (F.col("x") > F.lag("x").over(w)) & (F.col("y") > F.lag("y").over(w))
    # Only these can have equal ranks and all values different; the estimates are ten standard errors from it.
    high = pairs.join(f.where(~_exact(tolerance) & (F.col("corr") > 0) & (F.least("dx", "dy") >= 0.8 * F.col("n"))).select(*keys), keys)
    order = high.withColumn("up", F.coalesce(rises, F.lit(True))).groupBy(*keys).agg(F.min("up").alias("same_rank"))
    named = f.join(order, keys, "left")
    relation = F.when(_exact(tolerance), N.relation_label(F.col("slope"), F.col("intercept"), F.col("scale"), tolerance)).when(F.col("same_rank"), "same_rank").when(F.abs("corr") >= 0.995, "correlated")
    return named.select(*keys, "n", relation.alias("relation")).where("relation is not null")


#: Pairs of columns compared in one aggregate.
PAIR_BLOCK = 24


def digit_preservation(wide: DataFrame, table_id: Column, texts: dict[str, Column], share: float = 0.85, min_digits: int = 8) -> DataFrame:
    """(table_id, left, right, digit, n, share, flagged): how often two columns of a row have an equal ones, first decimal or last digit.

    ``texts`` are the columns' number texts by name, with a decimal point. Each cell's digits are read once; the pairs of columns are compared by sums over the
    rows as they are, so nothing is multiplied but the figures of a table.
    """
    kinds = {"ones": N.ones_of, "first_decimal": N.first_decimal_of, "terminal": N.terminal_of}
    names = list(texts)
    read = wide.select(table_id.alias("table_id"), *[t.alias(f"t{i}") for i, t in enumerate(texts.values())])
    read = read.select("table_id", *[f(F.col(f"t{i}")).alias(f"{k}{i}") for i in range(len(names)) for k, f in kinds.items()])
    pairs, out = list(combinations(range(len(names)), 2)), None
    for at in range(0, len(pairs), PAIR_BLOCK):
        part = [(i, j, k) for i, j in pairs[at : at + PAIR_BLOCK] for k in kinds]
        sums = [c for i, j, k in part for e in (F.col(f"{k}{i}") == F.col(f"{k}{j}"),) for c in (F.count(e).alias(f"n_{k}_{i}_{j}"), F.count_if(e).alias(f"k_{k}_{i}_{j}"))]
        rows = [F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), F.lit(k).alias("digit"), F.col(f"n_{k}_{i}_{j}").alias("n"), F.col(f"k_{k}_{i}_{j}").alias("k")) for i, j, k in part]
        g = read.groupBy("table_id").agg(*sums).select("table_id", F.explode(F.array(*rows)).alias("d")).select("table_id", "d.*").where(F.col("n") >= min_digits)
        out = g if out is None else out.unionByName(g)
    s = F.col("k") / F.col("n")
    return out.select("table_id", "left", "right", "digit", "n", F.round(s, 6).alias("share"), (s >= share).alias("flagged"))


def time_shifts(pairs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(table_id, base_a, base_b, n_times, n_offsets): groups of columns shifted by a constant at two or more times."""
    lt, rt = N.time_token(F.col("left")), N.time_token(F.col("right"))
    near = fits(pairs).where(lt == rt).where((F.abs(F.col("slope") - 1) <= 0.01) & (F.abs("intercept") > tolerance * F.col("scale")) & (F.col("worst") <= tolerance * F.col("scale")))
    a, b = N.time_base(F.col("left")), N.time_base(F.col("right"))
    g = near.groupBy("table_id", F.least(a, b).alias("base_a"), F.greatest(a, b).alias("base_b"))
    return g.agg(F.count("*").alias("n_times"), F.count_distinct(F.round("intercept", 6)).alias("n_offsets")).where("n_times >= 2")


def longitudinal(series: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(table_id, n_rows, n_linear, share, flagged): rows whose values change by the same step from time to time.

    ``series`` has (table_id, row_id, values array<double> in order of time); rows with a null value or fewer than four times are left out.
    """
    s = series.where(F.size("values") >= 4).where(~F.exists("values", lambda v: v.isNull()))
    diffs = F.zip_with(F.slice("values", F.lit(2), F.size("values") - 1), F.slice("values", F.lit(1), F.size("values") - 1), lambda b, a: b - a)
    s = s.withColumn("diffs", diffs)
    mean = F.aggregate("diffs", F.lit(0.0), lambda a, d: a + d) / F.size("diffs")
    scale = F.greatest(F.lit(1.0), F.array_max(F.transform("values", F.abs)))
    s = s.withColumn("mean", mean).withColumn("scale", scale)
    linear = F.array_max(F.transform("diffs", lambda d: F.abs(d - F.col("mean")))) <= tolerance * F.col("scale")
    g = s.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.count_if(linear).alias("n_linear"))
    share = F.col("n_linear") / F.col("n_rows")
    return g.select("table_id", "n_rows", "n_linear", F.round(share, 6).alias("share"), ((F.col("n_rows") >= 3) & (share >= 0.6)).alias("flagged"))


def repeated_increments(series: DataFrame, min_rows: int = 3) -> DataFrame:
    """(table_id, pattern, n_rows): equal steps (to four places) in three or more rows."""
    s = series.where(F.size("values") >= 4).where(~F.exists("values", lambda v: v.isNull()))
    diffs = F.zip_with(F.slice("values", F.lit(2), F.size("values") - 1), F.slice("values", F.lit(1), F.size("values") - 1), lambda b, a: F.round(b - a, 4).cast("decimal(18,4)").cast("string"))
    return s.groupBy("table_id", F.array_join(diffs, ",").alias("pattern")).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_rows)


def sequence_reuse(sequences: DataFrame, min_length: int = 4) -> DataFrame:
    """(n_values, n_columns, n_files, first_column): equal number sequences in two or more files.

    ``sequences`` has (file, col, values array<double>), values to ten places; files hold one array per column. Summary columns are left out.
    """
    s = sequences.where(~F.col("col").isin(*N.SUMMARY_COLUMNS)).where(F.size("values") >= min_length).withColumn("v", F.transform("values", lambda x: F.round(x, 10)))
    g = s.groupBy("v").agg(F.count("*").alias("n_columns"), F.count_distinct("file").alias("n_files"), F.min(F.concat_ws(":", "file", "col")).alias("first_column"))
    return g.where("n_files >= 2").select(F.size("v").alias("n_values"), "n_columns", "n_files", "first_column")


def pseudoreplication(df: DataFrame, table_id: Column, group: Column, biological: str, technical: str, basis: str) -> DataFrame:
    """(table_id, grp, n_biological, n_technical, n_rows, technical_basis): groups with more technical than biological units."""
    bio, tech = F.nullif(F.col(biological), F.lit("")), F.nullif(F.col(technical), F.lit(""))
    g = df.withColumns({"table_id": table_id, "grp": group}).groupBy("table_id", "grp").agg(
        F.count_distinct(bio).alias("n_biological"), F.count_distinct(F.when(tech.isNotNull(), F.struct(F.coalesce(bio, F.lit("")), tech))).alias("n_technical"), F.count("*").alias("n_rows"),
        F.coalesce(F.bool_or(F.lower(basis).isin("field", "fields", "well", "wells", "technical", "cell", "cells")), F.lit(False)).alias("technical_basis"),
    )
    return g.where("n_biological >= 1 and n_technical > n_biological")


def time_columns(cells: DataFrame, min_columns: int = 3, all_columns: int = 4, min_values: int = 3) -> DataFrame:
    """(table_id, base, n_columns, columns): columns that follow one another in time, by what their names have in common.

    ``cells`` has (table_id, col, col_pos, value). A table without ``min_columns`` such columns of one name counts as one series if it has
    ``all_columns`` numeric columns. Columns count with ``min_values`` numbers or more.
    """
    per = cells.where("value is not null").groupBy("table_id", "col", "col_pos").agg(F.count("*").alias("n")).where(F.col("n") >= min_values)
    listed = (F.count("*").alias("n_columns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_pos", "col"))), lambda x: x["col"]), ",").alias("columns"))
    timed = per.where(N.looks_time_column(F.col("col"))).groupBy("table_id", N.time_base(F.col("col")).alias("base")).agg(*listed).where(F.col("n_columns") >= min_columns)
    rest = per.join(timed.select("table_id").distinct(), "table_id", "left_anti").groupBy("table_id", F.lit("__time_series__").alias("base")).agg(*listed)
    return timed.unionByName(rest.where(F.col("n_columns") >= all_columns))
