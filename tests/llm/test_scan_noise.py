import random

from quillon.llm import scan_noise as S

BODY = [
    "the counted samples were stored after the second wash and the ledger was amended by the reader",
    "further animals of the fibroblast sheets showed a persistent volume following dose escalation",
    "both low- and high-dose intervals were recorded at the margin while the offset drifted",
] * 60


def found(spark, rows):
    base = [(f"b{i}", t + " " + str(i) + ".", "x", "y") for i, t in enumerate(BODY)]
    df = spark.createDataFrame(base + [(k, t, "x", "y") for k, t in rows], "paragraph_id string, text string, package_root string, word string")
    out: dict = {}
    for k, d in S.defects(df).collect():
        out.setdefault(k, set()).add(d)
    return df, out


def test_kinds_of_noise(spark):
    rows = [
        ("clean", "Both low- and high-dose samples (n = 4, K12) were\nstored after the second wash."),
        ("hyphen", "The persis-\ntent volume of the sheets"), ("soft", "The persis­ tent volume"), ("misread", "The c0unted sarnples were st0red"),
        ("header", "The counted samples were\nQuinto and Marlow et al.\nstored after the wash"), ("page", "The counted samples were\n— 12 —\nstored after the wash"),
        ("both", "The counted samples were stored\nSmith and Jones volume notes   [201]\nafter the second wash and the ledger"), ("inline", "The counted samples Annals of animal margin vol. 12 were p. 7 stored"),
        ("null", None), ("empty", ""), (None, "c0unted"), ("again", "The c0unted"), ("again", "The c0unted"), ("long", "stored after the wash " * 20_000),
    ]
    df, got = found(spark, rows)
    own = {k: v for k, v in got.items() if k not in {f"b{i}" for i in range(len(BODY))}}
    assert own == {
        "hyphen": {"hyphenation"}, "soft": {"hyphenation"}, "misread": {"misread"}, "header": {"running_header"}, "page": {"page_number"},
        "both": {"running_header", "page_number"}, "inline": {"running_header", "page_number"}, "again": {"misread"},
    }
    text = {r["paragraph_id"]: r["text"] for r in S.repaired(df).collect()}
    assert text["hyphen"] == "The persistent volume of the sheets" and text["misread"] == "The counted samples were stored"
    assert text["header"] == text["page"] == "The counted samples were stored after the wash"
    assert text["clean"] == "Both low- and high-dose samples (n = 4, K12) were stored after the second wash."


def test_reading_costs_and_deletes():
    assert S.reading_cost("sarnple", "sample") == S.CONFUSED
    assert S.reading_cost("sampel", "sample", 3.0) == 2 * S.EDIT and S.reading_cost("sampl", "sample", 3.0) == S.EDIT
    assert S.reading_cost("sample", "sample") is None and S.reading_cost("sampel", "sample") is None
    for seen, word in (("sarnple", "sample"), ("c0unted", "counted"), ("vvith", "with")):
        assert S.deletes(seen) & S.deletes(word)


def test_empty_table(spark):
    df = spark.createDataFrame([], "paragraph_id string, package_root string, text string")
    assert S.defects(df).count() == 0 and S.repaired(df).count() == 0


def test_headers_are_lines_that_recur_in_a_package(spark):
    page = "further animals of the fibroblast sheets showed a\n{}\npersistent volume following dose escalation in\nthe second wash of all samples"
    odd = "river in spring {}"  # no form of a header, but it stands in four paragraphs
    rows = [(f"r{i}", page.format(odd.format(i)), "p", "y") for i in range(4)] + [("once", page.format("only here it stands"), "p", "y"), ("other", page.format(odd.format(9)), "q", "y")]
    df = spark.createDataFrame(rows, "paragraph_id string, text string, package_root string, word string")
    got = {tuple(r) for r in S.defects(df).collect()}
    assert got == {(f"r{i}", "running_header") for i in range(4)}
    text = {r["paragraph_id"]: r["text"] for r in S.repaired(df).collect()}
    assert "river" not in text["r0"] and "river" in text["other"]


def test_planted_noise_is_found_again(spark):
    """Noise planted into clean text: precision and recall by kind, and the repaired text against the clean one."""
    r = random.Random(6)
    vocab = sorted({w for t in BODY for w in t.split() if w.isalpha() and len(w) > 4}) + ["incubation", "membrane", "horizon", "turbine", "molecule", "parallel", "chimney", "lantern"]
    clean, noisy, want = {}, [], set()
    for i in range(400):
        w = r.choices(vocab, k=40)
        clean[f"k{i}"] = " ".join(w)
        text = list(w)
        if i % 4 == 0:
            k = r.choice([k for k in range(40) if any(c in w[k][1:] for c in "oelm")])
            at = next(j for j in range(1, len(w[k])) if w[k][j] in "oelm")
            text[k] = w[k][:at] + {"o": "0", "e": "c", "l": "1", "m": "rn"}[w[k][at]] + w[k][at + 1 :]
            want.add((f"k{i}", "misread"))
        if i % 4 == 1:
            k = r.randrange(40)
            text[k] = w[k][:2] + "-\n" + w[k][2:]
            want.add((f"k{i}", "hyphenation"))
        lines = [" ".join(text[k : k + 8]) for k in range(0, 40, 8)]
        if i % 4 == 2:
            lines.insert(2, f"- {i} -")
            want.add((f"k{i}", "page_number"))
        noisy.append((f"k{i}", "\n".join(lines), "p"))
    df = spark.createDataFrame(noisy, "paragraph_id string, text string, package_root string")
    got = {tuple(x) for x in S.defects(df).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.98 * len(got), (sorted(want - got)[:5], sorted(got - want)[:5])
    text = {x["paragraph_id"]: x["text"] for x in S.repaired(df).collect()}
    assert sum(text[k] == t for k, t in clean.items()) >= 0.97 * len(clean)
