import random
import re

from quillon.llm import near_duplicates as N

SHAPE = "paragraph_id string, text string, similarity double, class string"


def shingles(t):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows, threshold):
    s = {k: shingles(t) for k, t in rows if k and shingles(t)}
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}


def corpus(seed=5, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = r.choices(words, k=r.randint(30, 150))
        for v in range(r.randint(1, 5)):
            t = list(base)
            for _ in range(r.choice([0, 1, 3, 8])):
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 1)] = [r.choice(words)]
            rows.append((f"p{i:03d}-{v}", " ".join(t)))
    return rows


def pairs(spark, rows, threshold):
    df = spark.createDataFrame([(k, t, 0.5, "c") for k, t in rows], SHAPE)
    return {(a, b) for a, b, _ in N.similar_pairs(df, "paragraph_id", threshold).collect()}


def test_pairs_are_those_of_brute_force(spark):
    rows = corpus()
    want = brute(rows, 0.5)
    got = pairs(spark, rows, 0.5)
    assert got <= want and len(got) >= 0.99 * len(want) > 20


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [("a", text), ("a", text), ("b", text.upper()), ("c", None), ("d", ""), ("e", "too short"), (None, text), ("f", "é " * 30), ("g", text + " " + "x" * 50_000)]
    assert pairs(spark, rows, 0.81) == {("a", "b")}
    assert pairs(spark, [], 0.8) == set()


def test_frequent_keys_are_joined_in_blocks(spark):
    rows = spark.createDataFrame([(k, v) for k, n in (("a", 25), ("b", 3), ("c", 1)) for v in [*range(n), 0]], "key string, value int")
    got = sorted((r["x"], r["y"]) for r in N.pairs_of(rows, "key", "value", 4).collect())
    assert got == sorted((x, y) for n in (25, 3) for x in range(n) for y in range(x + 1, n))


def test_recall_of_candidates():
    """Pairs at similarities around 0.5 and 0.8: what share of them shares a variant."""
    import numpy as np

    r = random.Random(3)
    for fresh, least in ((67, 0.99), (25, 1.0)):
        texts = []
        for k in range(300):
            common = [f"c{k}_{i}" for i in range(200)]
            own = lambda side, k=k, fresh=fresh: [f"{side}{k}_{i}" for i in range(int(fresh * 1.49))]
            for side in "xy":
                texts.append(" ".join([*common, *own(side)]))
        r.shuffle(texts)
        texts.sort(key=lambda t: t.split("_")[0])
        w, d = N.shingle_sets(texts)
        _, first = N.groups(d)
        keys = N._variants(N._signatures(w, first, N.SEGMENTS * N.WIDTH), N.SEGMENTS, N.WIDTH)
        hit = np.mean([bool(set(keys[:, 2 * k].tolist()) & set(keys[:, 2 * k + 1].tolist())) for k in range(300)])
        assert hit >= least, (fresh, hit)


def test_groups_and_links(spark):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows = [("p1", " ".join(t)), ("p2", " ".join([*t, "1"])), ("p3", " ".join([*t, "1", "2"])), ("p4", " ".join(t)), ("q", "entirely other words stand in this text")]
    df = spark.createDataFrame([(k, x, 0.0, "c") for k, x in rows], SHAPE)
    got = {r["paragraph_id"]: (r["group_id"], r["n_links"]) for r in N.similar_groups(df, "paragraph_id", 0.9).collect()}
    assert set(got) == {"p1", "p2", "p3", "p4"} and len({g for g, _ in got.values()}) == 1
    assert got["p1"][1] == got["p4"][1] == 2


def test_signatures_within_the_radius_share_a_variant():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (88, 1), dtype=np.uint32)
    for differ in range(0, 44):
        b = a.copy()
        b[rng.permutation(88)[:differ]] += 1
        assert set(N._variants(a, 22, 4).ravel().tolist()) & set(N._variants(b, 22, 4).ravel().tolist()), differ


def test_query_gives_every_pair_of_a_large_class(spark, tmp_path):
    """Texts that differ in case and line breaks only."""
    from quillon.llm.queries import p1_found

    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(f"k{i:03d}", text.replace(" ", "\n", i % 11) if i % 2 else text.upper()) for i in range(70)] + [("z", text + " thirteen")]
    spark.createDataFrame(rows, "paragraph_id string, text string").coalesce(1).write.parquet(str(tmp_path / "paragraphs.parquet"))
    got = [tuple(r) for r in p1_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.5)
