import random
import re
from collections import defaultdict

from quillon.llm import shared_spans as S

SHAPE = "paragraph_id string, text string, rec string, pos int"


def brute(rows, span):
    toks = {k: re.findall("[a-z0-9]+", t.lower()) for k, t in rows if k and t}
    where = defaultdict(set)
    for k, t in toks.items():
        for i in range(len(t) - span + 1):
            where[tuple(t[i : i + span])].add(k)
    out = set()
    for k, t in toks.items():
        hit = [False] * len(t)
        for i in range(len(t) - span + 1):
            if len(where[tuple(t[i : i + span])]) > 1:
                hit[i : i + span] = [True] * span
        i = 0
        while i < len(t):
            j = i
            while j < len(t) and hit[j]:
                j += 1
            if j > i:
                out.add((k, i, j - i))
            i = j + 1
    return out


def spans(spark, rows, span=20):
    df = spark.createDataFrame([(k, t, "r", 1) for k, t in rows], SHAPE)
    return {tuple(r) for r in S.shared_spans(df, "paragraph_id", span).collect()}


def test_spans_are_those_of_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    passages = [r.choices(words, k=r.randint(15, 70)) for _ in range(12)]
    rows = []
    for i in range(80):
        t = r.choices(words, k=r.randint(0, 60))
        for p in r.sample(passages, r.randint(0, 2)):
            a = r.randint(0, 10)
            t += p[a : a + r.randint(10, 60)] + r.choices(words, k=r.randint(0, 9))
        rows.append((f"p{i}", " ".join(t)))
    want = brute(rows, 20)
    assert spans(spark, rows) == want and len(want) > 15


def test_odd_rows_and_a_passage_in_a_third_of_all(spark):
    t = " ".join(f"t{i}" for i in range(25))
    rows = [("a", t), ("a", t), ("b", None), ("c", ""), (None, t), ("d", " ".join(f"t{i}" for i in range(19)))]
    assert spans(spark, rows) == set()
    many = [(f"k{i}", f"own{i} {t} end{i}") for i in range(200)] + [(f"o{i}", " ".join(f"o{i}x{j}" for j in range(30))) for i in range(400)]
    assert spans(spark, many) == {(f"k{i}", 1, 25) for i in range(200)}
    assert spans(spark, []) == set()


def test_repeats_within_one_record_are_not_shared(spark):
    t = " ".join(f"t{i}" for i in range(25))
    assert spans(spark, [("a", t + " mid " + t), ("b", "other")]) == set()
    df = spark.createDataFrame([("a", t, "r", 1), ("b", "x " + t, "r", 1)], SHAPE)
    got = {r["paragraph_id"]: r["shared_ratio"] for r in S.shared_amount(S.shared_spans(df, "paragraph_id"), df, "paragraph_id").collect()}
    assert got == {"a": 1.0, "b": round(25 / 26, 6)}
