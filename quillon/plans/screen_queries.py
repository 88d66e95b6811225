"""Queries and SQL of the number functions and statistical screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.operators import screens as S
from quillon.session import spread, table

SUMMARY = ["mean", "sd", "sem", "n", "p_value"]
PAIRED = ["control_day0", "treated_day0", "control_day2", "treated_day2", "doubled", "discount", "tax"]


def file_id() -> Column:
    """Names the file a row of a figure table comes from."""
    return F.concat_ws("/", "package_root", "figure_file")


def latest(df: DataFrame) -> DataFrame:
    """One row per row_id, the latest delivery."""
    cols = [c for c in df.columns if c not in ("row_id", "ingested_at")]
    return df.groupBy("row_id").agg(F.max(F.struct("ingested_at", *cols)).alias("r")).select("row_id", *[f"r.{c}" for c in cols])


def fig7(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "figure_7_summary"))


def fig6(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "figure_6_field_measurements"))


def figure_cells(spark: SparkSession, d: str) -> DataFrame:
    a = S.melt(fig7(spark, d), file_id(), F.col("row_id"), SUMMARY)
    return a.unionByName(S.melt(fig6(spark, d), file_id(), F.col("row_id"), ["value"]))


def line_cells(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of lineitem with two places, by flag and status."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = spread(table(spark, d, "lineitem")).select("l_returnflag", "l_linestatus", "l_orderkey", *[F.col(c).cast("decimal(18,2)").alias(c) for c in cols])
    cells = S.melt(li, F.concat("l_returnflag", "l_linestatus"), F.col("l_orderkey"), cols)
    return cells.select("table_id", "row_idx", "col", "col_pos", F.col("raw").alias("text"), F.col("raw").cast("double").alias("value"))


def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "figure_7_summary"), table(spark, d, "figure_6_field_measurements")
    every = a.select(F.explode(F.array("mean", "sd", "p_value")).alias("raw")).union(b.select("value"))
    return every.where("raw is not null").distinct()


def sc_numeric_text(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("raw")
    forms = {f"as_{k}": N.normal_number_text(r, F.lit(p)) for k, p in (("point", N.POINT), ("comma", N.COMMA), ("mixed", N.MIXED), ("ambiguous", N.AMBIGUOUS))}
    return distinct_values(spark, d).select("raw", N.raw_numeric_text(r).alias("text"), N.format_kind(r).alias("kind"), N.normal_number_text(r).alias("plain"), *[c.alias(k) for k, c in forms.items()], N.parse_number(r).alias("parsed"))


def sc_digits(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("raw")
    return distinct_values(spark, d).select(
        "raw", N.terminal_digit(r).alias("terminal"), N.decimal_places(r).cast("bigint").alias("places"), N.ones_digit(r).alias("ones"), N.first_decimal_digit(r).alias("first_decimal"),
        N.first_significant_digit(N.parse_number(r)).alias("significant"), F.round(N.half_ulp(r, 0.001), 9).alias("half_ulp"),
        N.range_has_integer(N.parse_number(r) * 4 - 0.1, N.parse_number(r) * 4 + 0.1, 0.001).alias("near_integer"),
    )


HEADERS = ("Animal ID", "Day0", "control_day7", "Tumour t3 volume", "week-2 mean", "baseline", "endpoint weight", "day4x", "treated H12", "p-value", "normalized treatment", "W1_day2", "d10", "holiday3")


def sc_headers(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("header")
    df = spark.createDataFrame([(x,) for x in HEADERS], "header string")
    return df.select("header", N.normal_header(h).alias("normal"), N.time_token(h).alias("token"), N.looks_time_column(h).alias("looks_time"), N.time_base(h).alias("base"))


def sc_row_labels(spark: SparkSession, d: str) -> DataFrame:
    """What names a row: the first column given, else its number."""
    label = N.first_given(F.col("field_id"), F.col("animal_id"), F.col("package_root"))
    identity = F.coalesce(N.first_given(F.col("animal_id"), F.col("field_id")), F.concat(F.lit("row"), F.col("row_id")))
    text = F.lower(F.concat_ws(" ", F.lit("animal_id field_id value reported_n_basis"), "animal_id", "field_id", "value", "reported_n_basis"))
    return fig6(spark, d).select("row_id", label.alias("label"), identity.alias("identity"), text.rlike("|".join(N.COUNT_HINTS)).alias("counts"))


def sc_suggested_risk(spark: SparkSession, d: str) -> DataFrame:
    df = spark.createDataFrame([(lv, w) for lv in ("R0", "R1", "R2", "R3", "R4") for w in (True, False)], "level string, weak boolean")
    return df.select("level", "weak", N.suggested_risk(F.col("level"), F.col("weak")).alias("suggestion"))


def a01_format_profiles(spark: SparkSession, d: str) -> DataFrame:
    return S.format_profiles(figure_cells(spark, d))


def a02_format_gaps(spark: SparkSession, d: str) -> DataFrame:
    return S.format_gaps(figure_cells(spark, d))


def a03_summary_checks(spark: SparkSession, d: str) -> DataFrame:
    return S.check_summaries(S.summary_rows(fig7(spark, d), file_id(), "row_id"))


def a09_integer_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.integer_counts(S.summary_rows(fig7(spark, d), file_id(), "row_id")).groupBy("table_id", F.coalesce("issue", F.lit("none")).alias("issue")).agg(F.count("*").alias("n_rows"))


def a10_terminal_digits(spark: SparkSession, d: str) -> DataFrame:
    return S.terminal_digits(S.numeric_cells(figure_cells(spark, d)))


def a10_terminal_digits_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return S.terminal_digits(line_cells(spark, d))


def a11_rounding(spark: SparkSession, d: str) -> DataFrame:
    return S.rounding(line_cells(spark, d)).unionByName(S.rounding(S.numeric_cells(figure_cells(spark, d))))


def a12_precision(spark: SparkSession, d: str) -> DataFrame:
    return S.precision_mix(S.numeric_cells(figure_cells(spark, d))).withColumn("places", F.col("places").cast("bigint"))


def a14_benford(spark: SparkSession, d: str) -> DataFrame:
    return S.benford(line_cells(spark, d))


def a15_p_clusters(spark: SparkSession, d: str) -> DataFrame:
    return S.p_clusters(S.numeric_cells(figure_cells(spark, d)))


def a16_repeated_summaries(spark: SparkSession, d: str) -> DataFrame:
    return S.repeated_summaries(S.summary_rows(fig7(spark, d), file_id(), "row_id"))


def paired_wide(spark: SparkSession, d: str) -> DataFrame:
    """Columns of lineitem with planted relations, in tables of some thousand rows."""
    price, quantity = F.col("l_extendedprice").cast("decimal(18,2)").cast("double"), F.col("l_quantity").cast("decimal(18,2)").cast("double")
    return spread(table(spark, d, "lineitem")).select(
        F.concat(F.lit("t"), F.pmod("l_suppkey", F.lit(20))).alias("table_id"), F.col("l_orderkey").alias("row_idx"), quantity.alias("control_day0"), (quantity + 10).alias("treated_day0"),
        price.alias("control_day2"), (price + 25.5).alias("treated_day2"), (price * 2).alias("doubled"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


def paired_columns(spark: SparkSession, d: str) -> DataFrame:
    return S.column_pairs(paired_wide(spark, d), F.col("table_id"), F.col("row_idx"), PAIRED)


def a17_fits(spark: SparkSession, d: str) -> DataFrame:
    f = S.fits(paired_columns(spark, d))
    return f.select("table_id", "left", "right", "n", F.round("slope", 4).alias("slope"), F.round("corr", 5).alias("corr"), (F.col("worst") <= 1e-6 * F.col("scale")).alias("exact"))


def a19_column_relations(spark: SparkSession, d: str) -> DataFrame:
    return S.column_relations(paired_columns(spark, d), 1e-7)


def a20_digit_preservation(spark: SparkSession, d: str) -> DataFrame:
    return S.digit_preservation(paired_wide(spark, d), F.col("table_id"), {c: F.col(c).cast("decimal(18,2)").cast("string") for c in PAIRED})


def a21_time_shifts(spark: SparkSession, d: str) -> DataFrame:
    return S.time_shifts(paired_columns(spark, d), 1e-7)


def order_series(spark: SparkSession, d: str) -> DataFrame:
    """Per customer the order totals' counts by quarter of 1995, and a planted mechanical series for each fifth customer."""
    q = F.quarter("o_orderdate")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(*[F.count_if(q == k).cast("double").alias(f"q{k}") for k in (1, 2, 3, 4)])
    planted = F.col("o_custkey") % 5 == 0
    values = F.when(planted, F.array(*[F.col("q1") + F.lit(2.0 * k) for k in range(4)])).otherwise(F.array("q1", "q2", "q3", "q4"))
    return o.select(F.when(planted, "planted").otherwise("orders").alias("table_id"), F.col("o_custkey").alias("row_id"), values.alias("values"))


def a22_longitudinal(spark: SparkSession, d: str) -> DataFrame:
    return S.longitudinal(order_series(spark, d))


def a23_repeated_increments(spark: SparkSession, d: str) -> DataFrame:
    return S.repeated_increments(order_series(spark, d))


def a24_time_columns(spark: SparkSession, d: str) -> DataFrame:
    """Series of columns in the figure tables and in a table of orders by customer and quarter."""
    q = F.quarter("o_orderdate")
    quarters = table(spark, d, "orders").groupBy("o_custkey").agg(*[F.count_if(q == k).alias(f"orders_week{k}") for k in (1, 2, 3, 4)], F.max("o_totalprice").alias("weight"))
    wide = S.melt(quarters, F.lit("orders"), F.col("o_custkey"), [c for c in quarters.columns if c != "o_custkey"]).withColumn("value", F.col("raw").cast("double"))
    columns = ["table_id", "col", "col_pos", "value"]
    return S.time_columns(wide.select(*columns).unionByName(S.numeric_cells(figure_cells(spark, d)).select(*columns)))


def a25_sequence_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Equal whole sequences of numbers, in row order, in two or more files: the figure tables' columns, and the quantities of each order as a file."""
    cells = S.numeric_cells(figure_cells(spark, d))
    seq = cells.groupBy("table_id", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), lambda x: x["value"]).alias("values"))
    lines = table(spark, d, "lineitem").groupBy(F.concat(F.lit("order-"), "l_orderkey").alias("file"))
    orders = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x["l_quantity"].cast("double")).alias("values"))
    return S.sequence_reuse(seq.select(F.col("table_id").alias("file"), "col", "values").unionByName(orders.select("file", F.lit("quantity").alias("col"), "values")))


def a26_pseudoreplication(spark: SparkSession, d: str) -> DataFrame:
    return S.pseudoreplication(fig6(spark, d), file_id(), F.lit("all"), "animal_id", "field_id", "reported_n_basis")


def a26_pseudoreplication_events(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("user"), F.col("event_id").cast("string").alias("event"), F.lit("event").alias("basis"))
    return S.pseudoreplication(ev, F.lit("events"), F.col("event_type"), "user", "event", "basis")


_NAMES = """sc_numeric_text sc_digits sc_headers sc_row_labels sc_suggested_risk a01_format_profiles a02_format_gaps a03_summary_checks a09_integer_counts a10_terminal_digits
a10_terminal_digits_lineitem a11_rounding a12_precision a14_benford a15_p_clusters a16_repeated_summaries a17_fits a19_column_relations a20_digit_preservation a21_time_shifts
a22_longitudinal a23_repeated_increments a24_time_columns a25_sequence_reuse a26_pseudoreplication a26_pseudoreplication_events"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}


# SQL

_T = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_EU, _US = r"'^[+-]?[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+%?$'", r"'^[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?%?$'"


def _raw(c: str) -> str:
    t = _T.format(c)
    return f"case when {t} <> '' and lower({t}) not in ('na', 'n/a', 'nan', 'null', '-') and {t}[1] not in ('<', '>') then {t} end"


def _amb(t: str) -> str:
    return f"(regexp_matches({t}, '^[+-]?[0-9]{{1,3}},[0-9]{{3}}%?$') and not regexp_matches({t}, '^[+-]?0+,'))"


def _dec(t: str) -> str:
    return f"(regexp_matches({t}, '^[+-]?[0-9]+,[0-9]+%?$') and not {_amb(t)})"


def _kind(t: str) -> str:
    return rf"""case when regexp_matches({t}, {_EU}) then '{N.COMMA}' when contains({t}, ',') and not contains({t}, '.') and {_amb(t)} then '{N.AMBIGUOUS}'
 when contains({t}, ',') and not contains({t}, '.') and {_dec(t)} then '{N.COMMA}'
 when contains({t}, '.') and not contains({t}, ',') and regexp_matches({t}, '^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?%?$') then '{N.POINT}'
 when contains({t}, ',') and contains({t}, '.') and regexp_matches({t}, {_US}) then '{N.POINT}' end"""


def _norm(t: str, p: str = "''") -> str:
    comma, point = f"contains({t}, ',')", f"contains({t}, '.')"
    eu, us, pt = f"replace(replace({t}, '.', ''), ',', '.')", f"replace({t}, ',', '')", f"replace({t}, ',', '.')"
    return f"""case when {p} = '{N.MIXED}' then case when not {comma} then {t} end when {p} = '{N.AMBIGUOUS}' and {_amb(t)} then null
 when {p} = '{N.COMMA}' then case when regexp_matches({t}, {_EU}) then {eu} when {comma} and not {point} then {pt} when not {comma} then {t} end
 when {comma} and {point} then case when regexp_matches({t}, {_US}) then {us} when regexp_matches({t}, {_EU}) then {eu} end
 when {comma} then case when {_amb(t)} then null when {_dec(t)} then case when {p} <> '{N.POINT}' then {pt} end when regexp_matches({t}, {_US}) then {us} end
 else {t} end"""


def _num(x: str) -> str:
    return rf"case when regexp_matches({x}, '^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$') then try_cast({x} as double) end"


_PLAIN = "case when not contains(lower({0}), 'e') then {0} end"
_TERMINAL = "nullif(right(regexp_replace({0}, '[^0-9]', '', 'g'), 1), '')"
_PLACES = r"case when contains({0}, '.') then length(regexp_replace(regexp_replace({0}, '^[^.]*\.', ''), '%+$', '')) when {0} is not null then 0 end"
_ONES = r"nullif(right(regexp_replace(regexp_replace({0}, '\..*$', ''), '[^0-9]', '', 'g'), 1), '')"
_FIRST_DEC = r"case when contains({0}, '.') then nullif(left(regexp_replace(regexp_replace({0}, '^[^.]*\.', ''), '[^0-9]', '', 'g'), 1), '') end"
_SIGNIFICANT = "case when {0} > 0 and {0} < 'infinity'::double then nullif(regexp_extract({0}::varchar, '^[0.]*([1-9])', 1), '') end"


def _latest(name: str) -> str:
    return f"(select * exclude (k_) from (select *, row_number() over (partition by row_id order by ingested_at desc nulls last) as k_ from {name}) where k_ = 1)"


_VALUES = "vals as (select distinct raw from (select unnest([mean, sd, p_value]) as raw from figure_7_summary union all select \"value\" from figure_6_field_measurements) where raw is not null)"
_CELLS = f"""f7 as (select *, concat_ws('/', package_root, figure_file) as table_id from {_latest("figure_7_summary")}),
f6 as (select *, concat_ws('/', package_root, figure_file) as table_id from {_latest("figure_6_field_measurements")}),
cells as (select table_id, row_id as row_idx, unnest(['mean', 'sd', 'sem', 'n', 'p_value']) as col, unnest([mean, sd, sem, n, p_value]) as raw from f7
          union all select table_id, row_id, 'value', "value" from f6),
texts as (select *, {_raw("raw")} as t from cells),
kinds as (select *, {_kind("t")} as kind from texts),
counted as (select table_id, col, count(*) filter (kind = '{N.COMMA}') as c, count(*) filter (kind = '{N.POINT}') as p, count(*) filter (kind = '{N.AMBIGUOUS}') as a from kinds group by 1, 2),
profiles as (select table_id, col, case when c > 0 and p > 0 then '{N.MIXED}' when c > 0 then '{N.COMMA}' when a > 0 and p = 0 then '{N.AMBIGUOUS}' else '{N.POINT}' end as profile
             from counted where c + p + a > 0),
normal as (select k.*, profile, {_norm("t", "coalesce(profile, '')")} as text from kinds k left join profiles using (table_id, col)),
nums as (select *, {_num("text")} as val from normal),
numeric_cells as (select table_id, row_idx, col, text, val, {_PLAIN.format(_norm("text"))} as pt from nums where val is not null)"""
_LINE = """line_cells as (select l_returnflag || l_linestatus as table_id, l_orderkey as row_idx, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as col,
 unnest([l_quantity::decimal(18,2)::varchar, l_extendedprice::decimal(18,2)::varchar, l_discount::decimal(18,2)::varchar, l_tax::decimal(18,2)::varchar]) as text from lineitem),
numeric_cells as (select table_id, row_idx, col, text, text::double as val, text as pt from line_cells)"""
_ROWS = """rows_ as (select table_id, row_idx, max(val) filter (col = 'mean') as mean, max(val) filter (col = 'sd') as sd, max(val) filter (col = 'sem') as sem, max(val) filter (col = 'n') as n,
 max(val) filter (col = 'p_value') as p, max(text) filter (col = 'mean') as mean_text, max(text) filter (col = 'sd') as sd_text, max(text) filter (col = 'sem') as sem_text from nums where col <> 'value' group by 1, 2)"""


def _half(t: str) -> str:
    x = _PLAIN.format(_norm(t))
    return f"coalesce(0.5 * pow(10.0, -({_PLACES.format('(' + x + ')')})), 0.001)"


_HALVES = f"halves as (select *, {_half('mean_text')} as hm, {_half('sd_text')} as hs, {_half('sem_text')} as he from rows_)"


def _top(value: str, where: str) -> str:
    return f"""shares as (select table_id, col, {value} as v, count(*) as n, min(row_idx) as first from numeric_cells where col <> 'n' group by 1, 2, 3 having v is not null),
totals as (select *, sum(n) over (partition by table_id, col) as total, count(*) over (partition by table_id, col) as kinds, row_number() over (partition by table_id, col order by n desc, first, v desc) as k from shares),
top as (select * from totals where k = 1 and total >= {where})"""


_DIGITS = "select table_id, col, v as digit, n, total::bigint as total, round(n / total, 6) as share, n / total >= 0.65 as flagged from top"
_ROUND = f"""select table_id, col, count(d) as total, round(count(*) filter (d in ('0', '5')) / count(d), 6) as share, count(*) filter (d in ('0', '5')) / count(d) >= 0.85 as flagged
from (select *, {_TERMINAL.format("pt")} as d from numeric_cells) where col <> 'n' group by 1, 2 having count(d) >= 8"""
_CHI = " + ".join(f"pow(d{k} - log10(1 + 1.0 / {k}) * total, 2) / (log10(1 + 1.0 / {k}) * total)" for k in range(1, 10))
_CHECKS = {
    "n_not_a_count": ("R2", "n <= 0 or abs(n - round_even(n, 0)) > 1e-9"), "sd_negative": ("R3", "sd < 0"), "sem_negative": ("R3", "sem < 0"),
    "sd_sem_mismatch": ("R2", "n > 1 and abs(sd - sem * sqrt(n)) > greatest(greatest(0.001, abs(sem * sqrt(n)) * 0.001), hs + sqrt(n) * he)"),
    "sd_equals_sem": ("R2", "n > 2 and abs(sd - sem) <= greatest(0.001, abs(sem * sqrt(n)) * 0.001)"), "p_out_of_range": ("R3", "p < 0 or p > 1"),
    "tiny_relative_sd": ("R1", "abs(mean) > 0 and sd / abs(mean) < 1e-6"),
}
_SAFE_N = "case when n > 0 then n end"
_GRIM = f"""cand as (select table_id, row_idx, sd, round_even(n, 0) as k, mean * round_even(n, 0) as total, hm * round_even(n, 0) as half, greatest(0, sd - hs) as lo, sd + hs as hi
 from halves where abs(mean) < 1e15 and n > 0 and n < 1e15 and abs(n - round_even(n, 0)) <= 0.001 and round_even(n, 0) >= 6),
bounds as (select *, ceil(total - half - 0.001)::bigint as a, floor(total + half + 0.001)::bigint as b from cand),
tried as (select table_id, row_idx, unnest(range(a, b + 1)) as s, k, lo, hi from bounds where a <= b),
sq as (select *, lo*lo*(k-1) + s*s/k as sl, hi*hi*(k-1) + s*s/k as sh, lo*lo*k + s*s/k as pl, hi*hi*k + s*s/k as ph from tried),
ok as (select table_id, row_idx, bool_or(ceil(sl - r) <= floor(sh + r) or ceil(pl - r) <= floor(ph + r)) as good
       from (select *, greatest(0.02, 0.001 * greatest(1, abs(sl), abs(sh), abs(pl), abs(ph))) as r from sq) group by 1, 2),
issues as (select table_id, case when a > b then 'total' when sd >= 0 and k > 1 and not good then 'sum_of_squares' else 'none' end as issue from bounds left join ok using (table_id, row_idx))"""
_PAIR_COLS = {"control_day0": "q", "treated_day0": "q + 10", "control_day2": "pr", "treated_day2": "pr + 25.5", "doubled": "pr * 2", "discount": "l_discount", "tax": "l_tax"}
_PAIRS = f"""wide as (select 't' || (l_suppkey % 20) as table_id, l_orderkey as row_idx, * from (select *, l_quantity::decimal(18,2)::double as q, l_extendedprice::decimal(18,2)::double as pr from lineitem)),
long as (select table_id, row_idx, unnest([{", ".join(f"{{'a': '{a}', 'b': '{b}', 'x': {_PAIR_COLS[a]}, 'y': {_PAIR_COLS[b]}}}" for i, a in enumerate(PAIRED) for b in PAIRED[i + 1 :])}]) as p from wide),
pairs as (select table_id, row_idx, p.a as "left", p.b as "right", p.x as x, p.y as y from long where p.x is not null and p.y is not null),
fit as (select table_id, "left", "right", count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, corr(y, x) as r, greatest(1, max(abs(x)), max(abs(y))) as scale
        from pairs group by 1, 2, 3 having count(*) >= 4 and var_pop(x) > 0 and var_pop(y) > 0),
fits as (select f.*, w.worst from fit f join (select table_id, "left", "right", max(abs(y - (slope * x + intercept))) as worst from pairs join fit using (table_id, "left", "right") group by 1, 2, 3) w using (table_id, "left", "right"))"""
_DAY = """regexp_extract("{0}", '(day[0-9]+)', 1)"""
_SERIES = """o as (select o_custkey, """ + ", ".join(f"count(*) filter (quarter(o_orderdate) = {k})::double as q{k}" for k in (1, 2, 3, 4)) + """ from orders group by 1),
series as (select case when o_custkey % 5 = 0 then 'planted' else 'orders' end as table_id, o_custkey as row_id,
 case when o_custkey % 5 = 0 then [q1, q1 + 2, q1 + 4, q1 + 6] else [q1, q2, q3, q4] end as v from o),
steps as (select *, [v[2] - v[1], v[3] - v[2], v[4] - v[3]] as d from series)"""
_PSEUDO = """select table_id, grp, count(distinct bio) as n_biological, count(distinct case when tech is not null then coalesce(bio, '') || chr(1) || tech end) as n_technical, count(*) as n_rows,
coalesce(bool_or(basis in ('field', 'fields', 'well', 'wells', 'technical', 'cell', 'cells')), false) as technical_basis from src group by 1, 2 having n_biological >= 1 and n_technical > n_biological"""

_TIME = "t[0-9]+|day[0-9]+|d[0-9]+|week[0-9]+|w[0-9]+|hour[0-9]+|h[0-9]+|baseline|endpoint"

SQL = {
    "sc_numeric_text": f"""with {_VALUES}, t as (select raw, {_raw("raw")} as text from vals)
select raw, text, {_kind("text")} as kind, {_norm("text")} as plain, {_norm("text", f"'{N.POINT}'")} as as_point, {_norm("text", f"'{N.COMMA}'")} as as_comma, {_norm("text", f"'{N.MIXED}'")} as as_mixed,
{_norm("text", f"'{N.AMBIGUOUS}'")} as as_ambiguous, {_num("(" + _norm("text") + ")")} as parsed from t""",
    "sc_digits": f"""with {_VALUES}, t as (select raw, {_norm("(" + _raw("raw") + ")")} as text from vals), u as (select raw, {_PLAIN.format("text")} as p, {_num("text")} as v from t)
select raw, {_TERMINAL.format("p")} as terminal, {_PLACES.format("p")} as places, {_ONES.format("p")} as ones, {_FIRST_DEC.format("p")} as first_decimal, {_SIGNIFICANT.format("v")} as significant,
round(coalesce(0.5 * pow(10.0, -({_PLACES.format("p")})), 0.001), 9) as half_ulp, ceil(v * 4 - 0.1 - 0.001) <= floor(v * 4 + 0.1 + 0.001) as near_integer from u""",
    "sc_suggested_risk": """select level, weak, case when weak then 'R2_max' when level in ('R1', 'R2') then level || '_possible' when level = 'R4' then 'R4_only_if_direct_contradiction' else level end as suggestion
from (select unnest(['R0', 'R1', 'R2', 'R3', 'R4']) as level) cross join (select unnest([true, false]) as weak)""",
    "sc_row_labels": f"""select row_id, coalesce(nullif(field_id, ''), nullif(animal_id, ''), nullif(package_root, '')) as label, coalesce(nullif(animal_id, ''), nullif(field_id, ''), 'row' || row_id) as identity,
regexp_matches(lower(concat_ws(' ', 'animal_id field_id value reported_n_basis', animal_id, field_id, "value", reported_n_basis)), '{"|".join(N.COUNT_HINTS)}') as counts from {_latest("figure_6_field_measurements")}""",
    "a01_format_profiles": f"with {_CELLS} select * from profiles",
    "a02_format_gaps": f"""with {_CELLS}, bad as (select *, row_number() over (partition by table_id, col order by row_idx) as k, count(*) over (partition by table_id, col) as n_gaps
 from nums where profile is not null and contains(t, ',') and val is null) select table_id, col, profile, n_gaps, string_agg(raw, ' | ' order by k) as examples from bad where k <= 5 group by 1, 2, 3, 4""",
    "a03_summary_checks": f"with {_CELLS}, {_ROWS}, {_HALVES} " + " union all ".join(
        f"""select table_id, row_idx, '{k}' as "check", '{lv}' as level from (select * replace ({_SAFE_N if "sqrt" in c else "n"} as n) from halves) where {c}""" for k, (lv, c) in _CHECKS.items()),
    "a09_integer_counts": f"with {_CELLS}, {_ROWS}, {_HALVES}, {_GRIM} select table_id, issue, count(*) as n_rows from issues group by 1, 2",
    "a10_terminal_digits": f"with {_CELLS}, {_top(_TERMINAL.format('pt'), '8')} {_DIGITS}",
    "a10_terminal_digits_lineitem": f"with {_LINE}, {_top(_TERMINAL.format('pt'), '8')} {_DIGITS}",
    "a11_rounding": f"select * from (with {_LINE} {_ROUND}) union all select * from (with {_CELLS} {_ROUND})",
    "a12_precision": f"""with {_CELLS}, {_top(_PLACES.format('pt'), '8')} select table_id, col, v as places, kinds as n_places, total::bigint as total, round(n / total, 6) as share, kinds > 1 and n / total <= 0.8 as mixed,
min(v) over (partition by table_id) <> max(v) over (partition by table_id) as differs from top""",
    "a14_benford": f"""with {_LINE}, digits as (select table_id, {_SIGNIFICANT.format("val")}::int as d from numeric_cells where val > 0),
g as (select table_id, count(*) as total, {", ".join(f"count(*) filter (d = {k}) as d{k}" for k in range(1, 10))} from digits where d is not null group by 1)
select table_id, total, round({_CHI}, 6) as chi_square, {_CHI} >= 20 as flagged from g where total >= 30""",
    "a15_p_clusters": f"""with {_CELLS}, p as (select * from numeric_cells where col = 'p_value' and val between 0 and 1),
texts_ as (select table_id, col, text, count(*) as k, min(row_idx) as first from p group by 1, 2, 3), best as (select *, row_number() over (partition by table_id, col order by k desc, first, text desc) as r from texts_),
g as (select table_id, col, count(*) as total, count(*) filter ((val >= 0.05 - 0.005 and val < 0.05) or (val >= 0.01 - 0.005 and val < 0.01) or (val >= 0.001 - 0.005 and val < 0.001)) as near
 from p group by 1, 2 having count(*) >= 20)
select table_id, col, total, round(near / total, 6) as near_share, text as repeated_text, round(k / total, 6) as repeat_share, near / total >= 0.35 or k / total >= 0.25 as flagged from g join best using (table_id, col) where r = 1""",
    "a16_repeated_summaries": f"with {_CELLS}, {_ROWS} select table_id, mean_text, sd_text, count(*) as n_rows from rows_ where mean is not null and sd is not null group by 1, 2, 3 having count(*) >= 2",
    "a17_fits": f"""with {_PAIRS} select table_id, "left", "right", n, round(slope, 4) as slope, round(r, 5) as corr, worst <= 1e-6 * scale as exact from fits""",
    "a19_column_relations": f"""with {_PAIRS}, own as (select * from fits where {_DAY.format("left")} = '' or {_DAY.format("right")} = '' or {_DAY.format("left")} = {_DAY.format("right")}),
orders_ as (select table_id, "left", "right", bool_and(coalesce(x > px and y > py, k = 1)) as same_rank from (select table_id, "left", "right", x, y, lag(x) over w as px, lag(y) over w as py, row_number() over w as k
 from pairs window w as (partition by table_id, "left", "right" order by x, row_idx)) group by 1, 2, 3),
rel as (select own.*, case when r * r >= 0.999999 and worst <= 1e-7 * scale then
  case when abs(slope - 1) <= 0.01 and abs(intercept) <= 1e-7 * scale then 'duplicate' when abs(slope - 1) <= 0.01 then 'additive' when abs(intercept) <= 1e-7 * scale then 'multiplicative' else 'affine' end
  when same_rank then 'same_rank' when abs(r) >= 0.995 then 'correlated' end as relation from own left join orders_ using (table_id, "left", "right"))
select table_id, "left", "right", n, relation from rel where relation is not null""",
    "a20_digit_preservation": f"""with {_PAIRS}, t as (select table_id, "left", "right", x::decimal(18,2)::varchar as a, y::decimal(18,2)::varchar as b from pairs),
dg as ({" union all ".join(f'''select table_id, "left", "right", '{k}' as digit, {f.format("a")} as a, {f.format("b")} as b from t''' for k, f in (("ones", _ONES), ("first_decimal", _FIRST_DEC), ("terminal", _TERMINAL)))})
select table_id, "left", "right", digit, count(*) as n, round(avg((a = b)::int), 6) as share, avg((a = b)::int) >= 0.85 as flagged from dg where a is not null and b is not null group by 1, 2, 3, 4 having count(*) >= 8""",
    "a21_time_shifts": f"""with {_PAIRS}, s as (select *, trim(regexp_replace("left", 'day[0-9]+', ''), '_') as p, trim(regexp_replace("right", 'day[0-9]+', ''), '_') as q from fits
 where {_DAY.format("left")} <> '' and {_DAY.format("left")} = {_DAY.format("right")} and abs(slope - 1) <= 0.01 and abs(intercept) > 1e-7 * scale and worst <= 1e-7 * scale)
select table_id, least(p, q) as base_a, greatest(p, q) as base_b, count(*) as n_times, count(distinct round(intercept, 6)) as n_offsets from s group by 1, 2, 3 having count(*) >= 2""",
    "a22_longitudinal": f"""with {_SERIES}, f as (select table_id, list_max([abs(d[1] - m), abs(d[2] - m), abs(d[3] - m)]) <= 1e-9 * greatest(1, abs(v[1]), abs(v[2]), abs(v[3]), abs(v[4])) as linear
 from (select *, (d[1] + d[2] + d[3]) / 3 as m from steps)) select table_id, count(*) as n_rows, count(*) filter (linear) as n_linear, round(count(*) filter (linear) / count(*), 6) as share,
count(*) >= 3 and count(*) filter (linear) / count(*) >= 0.6 as flagged from f group by 1""",
    "a23_repeated_increments": f"""with {_SERIES} select table_id, concat_ws(',', d[1]::decimal(18,4)::varchar, d[2]::decimal(18,4)::varchar, d[3]::decimal(18,4)::varchar) as pattern, count(*) as n_rows from steps group by 1, 2 having count(*) >= 3""",
    "sc_headers": rf"""with v as (select unnest({list(HEADERS)!r}) as header), w as (select header, lower(regexp_extract(header, '(?i)(?:^|[^A-Za-z0-9])({_TIME})(?:$|[^A-Za-z0-9])', 1)) as token from v)
select header, replace(replace(lower(trim(header)), ' ', '_'), '-', '_') as normal, nullif(token, '') as token, regexp_matches(header, '(?i)(^|[_ -])({_TIME})($|[_ -])') as looks_time,
coalesce(nullif(trim(regexp_replace(regexp_replace(replace(header, '_', ' '), '(?i)\b({_TIME})\b', '', 'g'), '[ -]+', '_', 'g'), '_'), ''), '__time_series__') as base from w""",
    "a24_time_columns": f"""with {_CELLS}, q as (select o_custkey, {", ".join(f"count(*) filter (quarter(o_orderdate) = {k}) as w{k}" for k in (1, 2, 3, 4))} from orders group by 1),
per as (select table_id, col, array_position(['mean', 'sd', 'sem', 'n', 'p_value', 'value'], col) as pos from numeric_cells group by 1, 2 having count(*) >= 3),
timed as (select 'orders' as table_id, 'orders' as base, 4::bigint as n_columns, 'orders_week1,orders_week2,orders_week3,orders_week4' as columns from q having count(*) >= 3)
select * from timed union all select table_id, '__time_series__', count(*), string_agg(col, ',' order by pos) from per group by 1 having count(*) >= 4""",
    "a25_sequence_reuse": f"""with {_CELLS}, seqs as (select table_id, col, list(round(val, 10) order by row_idx) as v from numeric_cells where col = 'value' group by 1, 2
 union all select 'order-' || l_orderkey, 'quantity', list(l_quantity::double order by l_linenumber, l_quantity) from lineitem group by l_orderkey)
select len(v) as n_values, count(*) as n_columns, count(distinct table_id) as n_files, min(table_id || ':' || col) as first_column from seqs where len(v) >= 4 group by v having count(distinct table_id) >= 2""",
    "a26_pseudoreplication": f"""with src as (select concat_ws('/', package_root, figure_file) as table_id, 'all' as grp, nullif(animal_id, '') as bio, nullif(field_id, '') as tech, lower(reported_n_basis) as basis
 from {_latest("figure_6_field_measurements")}) {_PSEUDO}""",
    "a26_pseudoreplication_events": f"with src as (select 'events' as table_id, event_type as grp, user_id::varchar as bio, event_id::varchar as tech, 'event' as basis from events) {_PSEUDO}",
}
