import numpy as np
from pyspark.sql import functions as F

from quillon.functions import numbers as N
from quillon.functions.paths import normal_path, references
from quillon.operators import screens as S
from quillon.sources import files, sinks


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_paths(spark):
    assert column(spark, normal_path, [" .\\A//b.C ", "././x", None, ""]) == ["a/b.c", "x", None, ""]
    assert column(spark, references, ["a; N/A |./B", None, " - ;none"]) == [["a", "b"], [], []]


def test_numbers(spark):
    got = column(spark, N.parse_number, ["1.5", "1,234", "1,23", "1.234,5", "1,234.5", "<3", "NA", "1d", "inf", "0,123", None])
    assert got == [1.5, None, 1.23, 1234.5, 1234.5, None, None, None, None, 0.123, None]
    assert column(spark, N.decimal_places, ["1.50", "2", "1e3", "1.5%"]) == [2, 0, None, 1]
    assert column(spark, N.time_token, ["control_day7", "holiday3", "T3"]) == ["day7", None, "t3"]
    assert column(spark, N.time_base, ["control_day7", "day7"]) == ["control", "__time_series__"]


def test_integer_counts_match_brute_force(spark):
    def possible(mean, sd, n):
        """All multisets of counts 0..12 of size n=6 with the reported mean and SD to two places."""
        from itertools import combinations_with_replacement

        for xs in combinations_with_replacement(range(8), n):
            m = np.mean(xs)
            if round(m, 2) == mean and (abs(np.std(xs, ddof=1) - sd) <= 0.0051 or abs(np.std(xs) - sd) <= 0.0051):
                return True
        return False

    cases = [("2.50", "1.05"), ("2.51", "1.05"), ("2.50", "1.00"), ("3.00", "0.00"), ("1.17", "0.41")]
    rows = spark.createDataFrame([("t", i, float(m), float(s), 6.0, m, s) for i, (m, s) in enumerate(cases)], "table_id string, row_idx int, mean double, sd double, n double, mean_text string, sd_text string")
    got = {r["row_idx"]: r["issue"] for r in S.integer_counts(rows).collect()}
    for i, (m, s) in enumerate(cases):
        if possible(float(m), float(s), 6):
            assert got[i] is None, cases[i]
    assert got[1] == "total"


def test_screens_keep_to_their_gates(spark):
    cells = spark.createDataFrame([("t", i, "v", 0, f"{i}.5") for i in range(7)], "table_id string, row_idx int, col string, col_pos int, raw string")
    assert S.terminal_digits(S.numeric_cells(cells)).count() == 0
    more = cells.union(cells.selectExpr("table_id", "row_idx + 7", "col", "col_pos", "raw"))
    row = S.terminal_digits(S.numeric_cells(more)).first()
    assert (row["digit"], row["total"], row["flagged"]) == ("5", 14, True)
    assert S.benford(S.numeric_cells(cells.limit(0))).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_bytes("﻿ID;Day 1\nx;1,5\n".encode())
    (tmp_path / "sub/b.tsv").write_text("id\tv\n\"q\"\t2\n")
    (tmp_path / "note.pdf").write_text("plain")
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "e.csv").write_text("")
    root = f"file://{tmp_path}"
    assert sorted((r["row_idx"], r["col"], r["raw"]) for r in files.delimited(spark, root).collect()) == [(2, "day_1", "1,5"), (2, "id", "q"), (2, "id", "x"), (2, "v", "2")]
    assert sorted(r["col"] for r in files.delimited(spark, root, sniffed=False).collect()) == ["id", "id;day_1", "v"]
    inv = {r["path"]: r for r in files.inventory(spark, root).collect()}
    assert set(inv) == {"a.csv", "note.pdf", "sub/b.tsv"} and inv["note.pdf"]["size_bytes"] == 5
    assert [r["text"] for r in files.texts(spark, root).collect()] == ["plain"]
    assert files.eight_bit(np.array([[0, 65535], [5, np.nan]])).dtype == np.uint8
    assert not files.eight_bit(np.full((2, 2), 7)).any()


def test_sinks(spark, tmp_path):
    assert column(spark, sinks.safe_cell, ["=1+1", " @x", "ok", None, "-5"]) == ["'=1+1", "' @x", "ok", "", "'-5"]
    text = sinks.report("T", {"x": spark.createDataFrame([(1, "a|b")], "n int, s string")}, {"k": 1})
    assert sinks.summary_of(text) == {"k": 1} and "a\\|b" in text


def test_phrase_results_prefer_the_equal_key(spark):
    q = spark.createDataFrame([("abc",), ("zzz",), ("ab",)], "phrase string")
    fixture = spark.createDataFrame([(0, "xabcx"), (1, "abc"), (2, "b")], "pos int, key string")
    assert dict(files.phrase_results(q, fixture).collect()) == {"abc": "abc", "ab": "xabcx"}
