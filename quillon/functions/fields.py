"""Patterns and expressions for the fields of delimited rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number: sign, digits with at most one point or comma, exponent, percent sign.
MANTISSA = r"[+-]?(?:[0-9]++(?:[.,][0-9]*+)?|[.,][0-9]++)"
NUMBER = MANTISSA + r"(?:[eE][+-]?[0-9]++)?%?"
#: What stands for "no value" (compared in lower case).
MISSING = ("", "na", "n/a", "nan", "null", "-")
#: What a whole-row pattern admits without a closer look: missing values and numbers with a point, without exponent, that
#: can't overflow. It holds no delimiter. The rest isn't wrong but goes on to the field patterns.
NO_VALUE = r"[Nn][Aa]|[Nn]/[Aa]|[Nn][Aa][Nn]|[Nn][Uu][Ll][Ll]|-"
SIMPLE = rf" *+(?:{NO_VALUE}|[<>]? *+[+-]?[0-9]{{1,200}}(?:[.][0-9]{{0,200}})?%?)? *+"
SIMPLE_P = rf" *+(?:{NO_VALUE}|[<>] *+[0-9]{{1,200}}(?:[.][0-9]{{0,200}})?|0{{1,9}}(?:[.][0-9]{{0,200}})?|1(?:[.]0{{0,200}})?)? *+"
ENCLOSED = r'"[^"]*+(?:""[^"]*+)*+"'


def trim_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def acceptable(c: Column, probability: bool = False) -> Column:
    """Whether a value can be loaded: missing, a finite number, or a bound ``<x``/``>x``; a probability lies in 0..1."""
    t = trim_blank(c)
    bound = F.regexp_extract(t, rf"^([<>]?)[ \t]*+{NUMBER}$", 1)
    shaped = t.rlike(rf"^[<>]?[ \t]*+{NUMBER}$")
    value = number(t)
    finite = value.isNotNull() & (F.abs(value) < float("inf"))
    good = shaped & finite
    if probability:
        good = good & ((bound != "") | value.between(0.0, 1.0))
    return c.isNull() | F.lower(t).isin(*MISSING) | F.coalesce(good, F.lit(False))


def number(c: Column) -> Column:
    """The number in a trimmed value, a bound's sign dropped, a percentage divided by 100; null if there is none."""
    digits = F.regexp_extract(c, rf"^[<>]?[ \t]*+({NUMBER})$", 1)
    plain = F.translate(digits, ",%", ".")
    return plain.try_cast("double") / F.when(digits.endswith("%"), 100.0).otherwise(1.0)


def field_pattern(delimiter: Column) -> Column:
    """Pattern of any well-formed field: enclosed, or free of quotes and delimiters."""
    return F.concat(F.lit(rf"(?:{ENCLOSED}|[^\""), delimiter, F.lit("]*+)"))


def split_fields(line: Column, delimiter: Column) -> Column:
    """The fields of a well-formed row, quotes removed."""
    raw = F.regexp_extract_all(F.concat(delimiter, line), F.concat(delimiter, F.lit("("), field_pattern(delimiter), F.lit(")")), F.lit(1))
    return F.transform(raw, lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
