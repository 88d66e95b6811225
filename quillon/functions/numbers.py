"""Numbers written as text: formats, digits, precision; and the column names that hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.paths import strip

#: Fixed values.
MISSING = ("na", "n/a", "nan", "null", "-")
SUMMARY_COLUMNS = ("mean", "sd", "sem", "se", "n", "p", "p_value", "pvalue")
P_COLUMNS = ("p", "p_value", "pvalue", "pval", "p_adj", "padj")
COUNT_HINTS = ("count", "counts", "integer", "event", "events", "cell", "cells", "colony", "colonies", "foci", "lesion", "lesions", "number")
POINT, COMMA, MIXED, AMBIGUOUS = "decimal_point", "decimal_comma", "mixed_decimal_separators", "ambiguous_comma_numeric"
POINT_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?%?$"
US_THOUSANDS = r"^[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?%?$"
EU_THOUSANDS = r"^[+-]?[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+%?$"
ONE_COMMA = r"^[+-]?[0-9]+,[0-9]+%?$"
AMBIGUOUS_COMMA = r"^[+-]?(?!0+,)[0-9]{1,3},[0-9]{3}%?$"
PLAIN_FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
TIME_WORDS = r"t\d+|day\d+|d\d+|week\d+|w\d+|hour\d+|h\d+|baseline|endpoint"


def let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def raw_numeric_text(c: Column) -> Column:
    """Trimmed text of a value; null if it is missing or a bound."""
    return let(strip(c), lambda t: F.when((t != "") & ~F.lower(t).isin(*MISSING) & ~t.rlike("^[<>]"), t))


def ambiguous_comma(t: Column) -> Column:
    """One comma that may part thousands or decimals."""
    return t.rlike(AMBIGUOUS_COMMA)


def decimal_comma(t: Column) -> Column:
    return t.rlike(ONE_COMMA) & ~ambiguous_comma(t)


def format_kind(c: Column) -> Column:
    return let(raw_numeric_text(c), _kind)


def _kind(t: Column) -> Column:
    comma, point = t.contains(","), t.contains(".")
    return (
        F.when(t.rlike(EU_THOUSANDS), COMMA)
        .when(comma & ~point & ambiguous_comma(t), AMBIGUOUS)
        .when(comma & ~point & decimal_comma(t), COMMA)
        .when(point & ~comma & t.rlike(POINT_NUMBER), POINT)
        .when(comma & point & t.rlike(US_THOUSANDS), POINT)
    )


def column_profile(kind: Column) -> Column:
    """Aggregate: the format of a column from its values' kinds; null if none is known."""
    n = lambda k: F.count_if(kind == k) > 0
    return (
        F.when(n(COMMA) & n(POINT), MIXED).when(n(COMMA), COMMA).when(n(AMBIGUOUS) & ~n(POINT), AMBIGUOUS).when(n(POINT) | n(AMBIGUOUS), POINT)
    )


def normal_number_text(c: Column, profile: Column | None = None) -> Column:
    """The value with a decimal point and without thousands marks; null where the column's format leaves it unclear."""
    p = F.coalesce(profile, F.lit("")) if profile is not None else F.lit("")
    return let(raw_numeric_text(c), lambda t: _normal(t, p))


def _normal(t: Column, p: Column) -> Column:
    comma, point = t.contains(","), t.contains(".")
    eu = F.translate(F.translate(t, ".", ""), ",", ".")
    us, pointed = F.translate(t, ",", ""), F.translate(t, ",", ".")
    return (
        F.when(p == MIXED, F.when(~comma, t))
        .when((p == AMBIGUOUS) & ambiguous_comma(t), F.lit(None))
        .when(p == COMMA, F.when(t.rlike(EU_THOUSANDS), eu).when(comma & ~point, pointed).when(~comma, t))
        .when(comma & point, F.when(t.rlike(US_THOUSANDS), us).when(t.rlike(EU_THOUSANDS), eu))
        .when(comma, F.when(ambiguous_comma(t), F.lit(None)).when(decimal_comma(t), F.when(p != POINT, pointed)).when(t.rlike(US_THOUSANDS), us))
        .otherwise(t)
    )


def parse_number(c: Column, profile: Column | None = None) -> Column:
    """Double, or null. Only plain decimal notation is read: ``inf``, ``nan``, ``1d`` and hexadecimal numbers are not."""
    return let(normal_number_text(c, profile), lambda t: F.when(t.rlike(PLAIN_FLOAT), t.try_cast("double")))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _plain(c: Column) -> Column:
    return let(normal_number_text(c), _unless_exponent)


def _unless_exponent(t: Column) -> Column:
    return F.when(~F.lower(t).contains("e"), t)


def terminal_digit(c: Column) -> Column:
    return F.nullif(F.right(_digits(_plain(c)), F.lit(1)), F.lit(""))


def decimal_places(c: Column) -> Column:
    return let(_plain(c), lambda t: F.when(t.contains("."), F.length(F.regexp_replace(F.regexp_replace(t, r"^[^.]*\.", ""), "%+$", ""))).when(t.isNotNull(), 0))


def ones_digit(c: Column) -> Column:
    return F.nullif(F.right(_digits(F.regexp_replace(_plain(c), r"\..*$", "")), F.lit(1)), F.lit(""))


def first_decimal_digit(c: Column) -> Column:
    return let(_plain(c), lambda t: F.when(t.contains("."), F.nullif(F.left(_digits(F.regexp_replace(t, r"^[^.]*\.", "")), F.lit(1)), F.lit(""))))


# The same for texts that are known to be numbers with a decimal point, as numeric cells have them: without patterns and lambdas.


def _bare(t: Column) -> Column:
    return F.translate(_unless_exponent(t), "+-%", "")


def _decimals(t: Column) -> Column:
    return F.when(t.contains("."), F.substring_index(_bare(t), ".", -1))


def terminal_of(t: Column) -> Column:
    return F.nullif(F.right(F.translate(_bare(t), ".", ""), F.lit(1)), F.lit(""))


def places_of(t: Column) -> Column:
    return F.when(t.contains("."), F.length(_decimals(t))).when(_unless_exponent(t).isNotNull(), 0)


def ones_of(t: Column) -> Column:
    return F.nullif(F.right(F.substring_index(_bare(t), ".", 1), F.lit(1)), F.lit(""))


def first_decimal_of(t: Column) -> Column:
    return F.nullif(F.left(_decimals(t), F.lit(1)), F.lit(""))


def first_significant_digit(v: Column) -> Column:
    """The first digit of a positive finite double, read from its decimal text."""
    return F.when((v > 0) & (v < float("inf")), F.nullif(F.regexp_extract(v.cast("string"), "^[0.]*([1-9])", 1), F.lit("")))


def half_ulp(c: Column, default: float) -> Column:
    """Half a unit of the last place that was reported."""
    return F.coalesce(0.5 * F.pow(F.lit(10.0), -decimal_places(c)), F.lit(default))


def range_has_integer(low: Column, high: Column, tolerance: Column | float) -> Column:
    return F.ceil(low - tolerance) <= F.floor(high + tolerance)


def normal_header(c: Column) -> Column:
    return F.translate(F.lower(strip(c)), " -", "__")


def time_token(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, rf"(?i)(?<![A-Za-z0-9])({TIME_WORDS})(?![A-Za-z0-9])", 1)), F.lit(""))


def looks_time_column(c: Column) -> Column:
    return c.rlike(rf"(?i)(^|[_\-\s])({TIME_WORDS})($|[_\-\s])")


def time_base(c: Column) -> Column:
    bare = F.regexp_replace(c, rf"(?i)(?<![A-Za-z0-9])({TIME_WORDS})(?![A-Za-z0-9])", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[_\-\s]+", "_"), "^_+|_+$", "")
    return F.when(bare != "", bare).otherwise("__time_series__")


def first_given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def relation_label(slope: Column, intercept: Column, scale: Column, tolerance: float) -> Column:
    same, shifted = F.abs(slope - 1) <= 0.01, F.abs(intercept) > tolerance * scale
    return F.when(same & ~shifted, "duplicate").when(same, "additive").when(~shifted, "multiplicative").otherwise("affine")


def suggested_risk(level: Column, weak: Column) -> Column:
    return (
        F.when(weak, "R2_max").when(level.isin("R1", "R2"), F.concat(level, F.lit("_possible"))).when(level == "R4", "R4_only_if_direct_contradiction").otherwise(level)
    )
