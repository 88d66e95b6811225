"""Queries written once as SQL, rendered for Spark and for the checking engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.session import table

TABLES = """region nation customer supplier part orders lineitem events documents embeddings paragraphs file_hash_manifest claim_manifest assembly_manifest
figure_7_summary figure_6_field_measurements raw_source_rows eval_items container_specs""".split()


class Spark:
    spark = True

    def lit(self, s: str) -> str:
        return "r'" + s + "'" if "\\" in s else "'" + s.replace("'", "\\'") + "'"

    def like(self, x: str, p: str) -> str:
        return f"({x} rlike {self.lit(p)})"

    def extract(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)}, 0)"

    def sub(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, '{r}')"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.lit(p)})"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def fn(self, v: str, body: str) -> str:
        return f"{v} -> {body}"

    def unnest(self, x: str) -> str:
        return f"explode({x})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def at(self, a: str, i: str) -> str:
        return f"try_element_at({a}, cast({i} as int))"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def collect(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def values(self, name: str, cols: str, rows: list[tuple]) -> str:
        return f"{name} as (select * from values {', '.join('(' + ', '.join(_lit(v) for v in r) + ')' for r in rows)} as v({cols}))"

    size, filter, transform, sha, contains, xor, text, length = "size", "filter", "transform", lambda _, x: f"sha2({x}, 256)", "contains", lambda _, a, b: f"bit_count({a} ^ {b})", "string", "length"


class Duck(Spark):
    spark = False

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def like(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.lit(p)})"

    def extract(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def all(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)})"

    def sub(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, '{r}', 'g')"

    def split(self, x: str, p: str) -> str:
        return f"string_split_regex({x}, {self.lit(p)})"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def fn(self, v: str, body: str) -> str:
        return f"lambda {v}: {body}"

    def unnest(self, x: str) -> str:
        return f"unnest({x})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def at(self, a: str, i: str) -> str:
        return f"({a})[{i}]"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, '{sep}')"

    def collect(self, x: str) -> str:
        return f"list_sort(list(distinct {x}))"

    def values(self, name: str, cols: str, rows: list[tuple]) -> str:
        return f"{name}({cols}) as (values {', '.join('(' + ', '.join(_lit(v) for v in r) + ')' for r in rows)})"

    size, filter, transform, sha, contains, xor, text, length = "len", "list_filter", "list_transform", lambda _, x: f"sha256({x})", "contains", lambda _, a, b: f"bit_count(xor({a}, {b}))", "varchar", "length"


def _lit(v) -> str:
    return "null" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


SPARK, DUCK = Spark(), Duck()


def query(write: Callable[[Spark], str]) -> Callable[[SparkSession, str], DataFrame]:
    """The Spark query for a function that writes SQL in a dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = write(SPARK)
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    run.__name__, run.__doc__ = write.__name__, write.__doc__
    return run


def both(writers: list[Callable[[Spark], str]]) -> tuple[dict, dict]:
    """QUERIES and SQL of several writers, by their names."""
    return {w.__name__: query(w) for w in writers}, {w.__name__: w(DUCK) for w in writers}
