"""Writers: CSV that spreadsheets don't run, JSON, and a text report with its machine-readable summary."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = "AUDIT_JSON_SUMMARY"


def safe_cell(c: Column) -> Column:
    """Text of a cell; one that a spreadsheet would take for a formula gets a quote in front; null becomes empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.regexp_replace(text, "^[ \\t\\r\\n\ufeff]+", "").rlike(r"^[=+@\-]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_csv(df: DataFrame, path: str) -> None:
    df.select(*[safe_cell(F.col(f"`{c}`")).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(title: str, tables: dict[str, DataFrame], summary: dict, rows: int = 50) -> str:
    """A Markdown report: the first ``rows`` rows of each table (a preview), and the summary in one fenced block."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in df.limit(rows).collect()] + [""]
    return "\n".join([*out, f"```{FENCE}", json.dumps(summary, sort_keys=True, default=str), "```", ""])


def summary_of(text: str) -> dict:
    """The summary in a report; empty if there is none."""
    m = re.search(rf"```{FENCE}\n(.*?)\n```", text, re.S)
    return json.loads(m[1]) if m else {}
