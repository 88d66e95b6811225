import pytest

from quillon.llm import language as L


@pytest.fixture(scope="module")
def trained(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select(L.label_language(docs["lang"]), "text").where("text is not null").collect() if r[0]]
    held = rows[::4]
    return L.train([r for k, r in enumerate(rows) if k % 4]), held


def test_held_out_accuracy(trained):
    net, held = trained
    segs = L.segment_languages(net, [t for _, t in held])
    one = [(lang, s[0][1]) for (lang, _), s in zip(held, segs, strict=True) if len(s) == 1]
    assert len(one) > 100
    assert sum(a == b for a, b in one) / len(one) > 0.93  # some labels are wrong
    rare = [(a, b) for a, b in one if a != "en"]
    assert sum(a == b for a, b in rare) / len(rare) > 0.8


def test_mixed_texts_and_quotes(trained):
    net, _ = trained
    de = "Die Auswertung der Gewebeschnitte lag deutlich über dem Mittelwert aller Tiere nach der nächtlichen Fixierung."
    en = "The outer margin with low values showed a persistent cohort of cells following dose escalation, because the offset drifted."
    segs = L.segment_languages(net, [en + "\n\n" + en + " " + de, en + " See “" + de[:40] + "” for the earlier notes.", de, "", "123 4.5", "  \n\n "])
    assert [(k, lang) for k, lang, _ in segs[0]] == [(1, "en"), (2, "en"), (2, "de")]
    assert [(k, lang) for k, lang, _ in segs[1]] == [(0, "en")] and [(k, lang) for k, lang, _ in segs[2]] == [(0, "de")]
    assert segs[3] == segs[4] == segs[5] == []
    assert all(0 < c <= 1 for s in segs for _, _, c in s)


def test_tables_give_what_convolutions_give():
    import numpy as np

    net = L.ByteNetwork(9)
    x, _ = L.byte_windows(["one short text", "ein längerer Text mit Umlauten, " * 9])
    emb = net.p["e"][x]
    pooled = []
    for w in L.WIDTHS:
        patch = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * L.DIM)
        pooled.append((patch @ net.p[f"w{w}"] + net.p[f"b{w}"]).max(1))
    z = np.maximum(np.concatenate(pooled, 1), 0) @ net.p["o"] + net.p["ob"]
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(x), want, atol=1e-4)


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en", " EN_gb", "deu", "Chinese", "zh-TW", "xx", "en,fr", None, "")], "lang string")
    assert [r[0] for r in df.select(L.label_language(df["lang"])).collect()] == ["en", "en", "de", "zh", "zh", None, None, None, None]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, seg_no int")
    assert L.wrong_labels(docs).count() == 0


def test_ideographs_next_to_numbers_and_codes(trained):
    zh = "体重的变化过程并不依赖354.3个单位的阈值并以TE-9342编号存档。"
    assert L.sentences(zh) == ["体重的变化过程并不依赖个单位的阈值并以te编号存档", ""]
    assert L.sentences("第3ED12，第４号pq7") == ["第第号"] and L.sentences("Lot AB12-x,9 of 1.5mg was kept.") == ["lot  of  was kept"]
    net, _ = trained
    en = "The outer margin with low values showed a persistent cohort of cells following dose escalation, because the offset drifted."
    assert [(k, lang) for k, lang, _ in L.segment_languages(net, [en + "\n\n" + zh])[0]] == [(1, "en"), (2, "zh")]


def test_quoted_titles_go_and_quoted_texts_stay():
    title = 'Die Proben wurden gezählt, siehe “The growth of cells” und danach gewogen.'
    assert "growth" not in " ".join(L.sentences(title)) and "danach gewogen" in " ".join(L.sentences(title))
    assert L.sentences('„Das Protokoll der Färbung wurde im Labor geändert und erneut gelesen.“')[0].startswith("das protokoll")
    assert any("nobody had read" in s for s in L.sentences('He said “This is long. And nobody had read it before the meeting.” Then he left.'))
    assert any("protokoll der färbung" in s for s in L.sentences("“Das Protokoll der Färbung”"))
    inches = L.sentences('The board is 5" long and was cut. It is quite heavy to carry around. The other is 6" wide.')
    assert any("quite heavy" in s for s in inches)
    assert L.sentences('See "Der Titel" for details of it')[0] == "see for details of it"
