from datetime import datetime

from quillon.operators import references, rows, snapshots
from quillon.operators.graph import components

T = [datetime(2031, 1, k) for k in range(1, 20)]
FILES = "package_root string, snapshot_no int, path string, sha256 string, received_at timestamp, change_kind string, key string"


def changes(spark, listed):
    df = spark.createDataFrame([(*r, "x", "y") for r in listed], FILES)
    return sorted(tuple(r)[:4] for r in snapshots.snapshot_changes(df, 2).collect())


def test_hashes_and_sizes_of_changes(spark):
    listed = [("a", 1, "one", "AA", 10), ("a", 1, "two", "bb", 20), ("a", 2, "one", "ab", None), ("a", 2, "three", None, 5), ("b", 2, "two", "c", 1)]
    df = spark.createDataFrame([(*r, T[0]) for r in listed], "package_root string, snapshot_no int, path string, sha256 string, size_bytes bigint, received_at timestamp")
    got = sorted(tuple(r) for r in snapshots.snapshot_changes(df, 3, sizes=True).collect())
    assert got == [("a", 2, "one", "changed", "aa", "ab", 10, None), ("a", 2, "three", "added", None, None, None, 5), ("a", 2, "two", "removed", "bb", None, 20, None)]
    assert sorted(tuple(r)[:4] for r in snapshots.snapshot_changes(df, 3, baseline=True).collect()) == [
        ("a", 1, "one", "added"), ("a", 1, "two", "added"), ("a", 2, "one", "changed"), ("a", 2, "three", "added"), ("a", 2, "two", "removed"), ("b", 2, "two", "added"),
    ]


def test_snapshot_changes_with_gaps_case_and_unknown_hashes(spark):
    listed = [
        ("a", 1, "./F//One.csv", "AA", T[0]), ("a", 1, "two", "bb", T[0]), ("a", 1, "three", None, T[0]), ("a", 1, "gone", "x", T[0]),
        ("a", 3, "f\\one.CSV", "aa", T[0]), ("a", 3, "two", "cc", T[1]), ("a", 3, "three", "dd", T[0]), ("a", 3, "new", "e", T[0]),
        ("a", 4, "f/one.csv", "zz", T[0]), ("a", 4, "two", "old", T[0]), ("a", 4, "two", "cc", T[1]), ("a", 4, "three", " ", T[0]), ("a", 4, "new", "e", T[0]),
        ("b", 3, "only", "q", T[0]), (None, 3, "n", "q", T[0]), ("a", 3, None, "q", T[0]), ("a", None, "p", "q", T[0]),
    ]
    want = [("a", 3, "gone", "removed"), ("a", 3, "new", "added"), ("a", 3, "two", "changed"), ("a", 4, "f/one.csv", "changed")]
    assert changes(spark, listed) == sorted(want)
    assert changes(spark, listed[::-1] + listed) == sorted(want)


def test_snapshot_changes_of_nothing(spark):
    assert changes(spark, []) == []
    assert changes(spark, [("a", 1, "p", "x", T[0])]) == []


RAW = "row_id bigint, package_root string, source_table string, figure_file string, line_no int, line string, received_at timestamp, target string, reason string"


def reasons(spark, lines, header="animal_id,field_id,value,basis", table="Figure_6_field_measurements"):
    data = [(1, "p", table, "f", 1, header, T[0], "t", "r")] + [(i + 2, "p", table, "f", i + 2, x, T[0], "t", "r") for i, x in enumerate(lines)]
    got = rows.check_rows(spark.createDataFrame(data, RAW))
    return {r["row_id"]: (r["reason"], r["broken_field"]) for r in got.collect()}


def test_rows_and_their_first_broken_field(spark):
    lines = ['a,b,1.5,x', 'a,b,"1,5",x', 'a,b,1.5', 'a,b,1.5,x,y', 'a,"b,1.5,x', 'a,"b"x,1.5,x', 'a,b,one,x', 'a,b,1e999,x', '"a,1\n","b ""q""",> 3,x\r', "", None, "a,b,,x", "a,b,12%,x", "a,b,-,x"]
    got = reasons(spark, lines)
    bad = {4: ("column_count", 4), 5: ("column_count", 5), 6: ("broken_quoting", 2), 7: ("broken_quoting", 2), 8: ("invalid_value", 3), 9: ("invalid_value", 3), 11: ("column_count", 2), 12: ("column_count", 2)}
    assert got == {i + 2: bad.get(i + 2, (None, None)) for i in range(len(lines))}


def test_probabilities_and_other_delimiters(spark):
    lines = ["C1;1,5;0,05", "C1;1.5;1.2", "C1;1.5;<1.2", "C1;1.5;5e-1", "C1;1.5;-0.1", "C1;1.5;1e0"]
    got = reasons(spark, lines, "﻿COMPARISON;MEAN;P_VALUE\r", "Figure_7_summary")
    assert [got[k][0] for k in sorted(got)] == [None, "invalid_value", None, None, "invalid_value", None]


def test_long_rows_and_empty_tables(spark):
    long = '"' + "x" * 200_000 + '",b,1,c'
    assert reasons(spark, [long])[2] == (None, None)
    assert rows.check_rows(spark.createDataFrame([], RAW)).count() == 0


CLAIMS = "row_id bigint, package_root string, snapshot_no int, source_data string, raw_record string, created_at timestamp, ingested_at timestamp, ref_path string, exist int"


def test_orphans(spark):
    manifest = spark.createDataFrame([("p", 1, "d/a.csv", "h", T[0], "", ""), ("p", 3, "d/a.csv", "h", T[0], "", ""), ("p", 3, "d/late.csv", "h", T[0], "", ""), ("p", 3, "e/b.csv", "h", T[0], "", "")], FILES)
    claims = [
        (1, "p", 1, "./D/a.csv; a.csv |none", "late.csv"), (2, "p", 2, "a.csv", "never"), (2, "p", 2, "a.csv", "never"), (3, "p", 3, "b.csv|x/b.csv", None), (4, None, 3, "q", "q"), (5, "other", 1, "a.csv", ""),
    ]
    df = spark.createDataFrame([(*r, T[5], T[6], "x", 1) for r in claims], CLAIMS)
    out = references.orphan_references({"claim_manifest": df}, manifest)
    got = sorted((r["row_id"], r["ref_field"], r["ref_path"], r["orphan_kind"]) for r in out.collect())
    assert got == [(1, "raw_record", "late.csv", "late"), (2, "raw_record", "never", "missing"), (2, "source_data", "a.csv", "deleted"), (3, "source_data", "x/b.csv", "missing"), (5, "source_data", "a.csv", "missing")]
    assert references.orphan_references({"claim_manifest": df.limit(0)}, manifest).count() == 0
    assert {r["period"] for r in out.collect()} == {"2031-01"}


def test_counts_are_kept_from_delivery_to_delivery(spark):
    listed = [("p", 1, "d/a.csv"), ("p", 1, "e/a.csv"), ("p", 2, "d/a.csv"), ("p", 4, "x"), ("q", 1, "z")]
    manifest = spark.createDataFrame([(*r, "h", T[0], "", "") for r in listed], FILES)
    claims = [(1, "p", 1, "nothing", None), (2, "p", 4, "a.csv; a.csv|x", "e/a.csv"), (3, "p", 4, "a.csv", None), (4, "q", 1, "z; y", None), (5, "q", 9, "w", None)]
    df = spark.createDataFrame([(*r, T[5], T[6], "x", 1) for r in claims], CLAIMS)
    got = sorted(tuple(r) for r in references.current_orphans({"claim_manifest": df}, manifest).collect())
    assert got == [("p", "a.csv", 2), ("p", "e/a.csv", 1), ("q", "y", 1)]
    assert references.current_orphans({"claim_manifest": df}, manifest.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (201, 200), (200, 201)]
    got = dict(components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0
