import random
import re

import numpy as np

from quillon.llm import leaks as L


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_verbatim_leaks_are_those_of_brute_force(spark):
    r = random.Random(2)
    vocab = [f"word{i}" for i in range(500)] + ["naïve", "Größe", "слово"]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(10, 60)))) for i in range(15)]
    docs = []
    for i in range(80):
        t = r.choices(vocab, k=r.randint(0, 80))
        if i % 2:
            w = items[r.randrange(15)][1].split()
            a = r.randint(0, max(0, len(w) - 14))
            t += [x.upper() if r.random() < 0.1 else x + "," for x in w[a : a + r.randint(9, 30)]]
        docs.append((i, " ".join(t)))
    runs = lambda t: {tuple(words(t)[k : k + 13]) for k in range(len(words(t)) - 12)}
    want = {(d, i) for d, t in docs for i, x in items if runs(t) & runs(x)}
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id int, text string, item_id int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, doc_id int")
    for limit in (L.INDEX_ENTRIES, 500):  # one index, and several groups of items
        got = {(r["doc_id"], r["item_id"]) for r in L.leaks(a, b, 13, 3, index_entries=limit).where("verbatim").collect()}
        assert got == want and len(want) > 10


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 40)) for _ in range(30)]
    for radius in (3, 11):
        (index,) = L.build(list(range(30)), texts, 13, radius)
        fp = index.fp[rng.integers(0, len(index.fp), 400)].copy()
        for k in range(400):
            for bit in rng.permutation(64)[: rng.integers(0, radius + 3)]:
                fp[k] ^= np.uint64(1) << np.uint64(bit)
        got = set(zip(*(x.tolist() for x in index.near(fp)), strict=True))
        want = {(i, j) for i in range(400) for j in range(len(index.fp)) if int(fp[i] ^ index.fp[j]).bit_count() <= radius}
        assert got == want


def similar_by_brute_force(doc, item, weight):
    """Greatest weighted similarity of the item with a window of its length, over all windows."""
    five = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    d, i = words(doc), words(item)
    mine, best = five(i), 0.0
    total = lambda s: sum(weight.get(x, 1.0) for x in s)
    for k in range(len(d) - len(i) + 1):
        own = five(d[k : k + len(i)])
        best = max(best, total(own & mine) / total(own | mine))
    return best


def test_edited_items_are_found(spark):
    """Copies with substituted, inserted, deleted or moved words, against all windows by brute force: recall and precision."""
    r = random.Random(8)
    vocab = [f"word{i}" for i in range(3000)]
    often = ["the", "of", "and", "which", "in"]
    text = lambda n: [r.choice(often) if r.random() < 0.3 else r.choice(vocab) for _ in range(n)]
    shared = text(25)
    items = [(i, text(r.randint(46, 118)) if i % 5 else shared + text(60)) for i in range(16)]
    docs = []
    for d in range(110):
        w = list(items[r.randrange(16)][1])
        for _ in range(r.choice([0, 1, 1, 1, 2, 2, 3])):
            k = r.randrange(len(w))
            w[k : k + r.choice([0, 1, 1])] = r.choice([[], [r.choice(vocab)], [r.choice(vocab)]])
        docs.append((d, " ".join(text(r.randint(0, 60)) + w + text(r.randint(0, 60)))))
    items = [(i, " ".join(t)) for i, t in items]
    n: dict = {}
    for _, t in items:
        for s in {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)}:
            n[s] = n.get(s, 0) + 1
    weight = {s: 1 / k for s, k in n.items()}
    want = {(d, i) for d, t in docs for i, x in items if similar_by_brute_force(t, x, weight) >= 0.8}
    a, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    rows = L.leaks(a, b).collect()
    got = {(x["doc_id"], x["item_id"]) for x in rows}
    assert got <= want and len(want) > 60
    assert len(got) >= 0.97 * len(want), (len(got), len(want))
    assert any(not x["verbatim"] for x in rows)


def test_odd_rows(spark):
    item = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, item), (4, item), (4, item), (5, "y " * 60_000 + item)], "doc_id int, text string")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "few words"), (None, item)], "item_id int, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_windows"], r["verbatim"]) for r in L.leaks(docs, items, 13).collect())
    assert got == [(4, 1, 8, True), (5, 1, 9, True)]  # a ninth window has twelve of the thirteen words
    assert sorted((r["doc_id"], r["n_windows"]) for r in L.leaks(docs, items).collect()) == [(4, 1), (5, 2)]
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0
