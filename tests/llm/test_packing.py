import random

from quillon.llm import packing as P

SPECS = [(1, 512), (2, 2048)]


def test_every_token_is_in_one_container(spark):
    r = random.Random(1)
    sizes = [(i, min(6000, int(r.lognormvariate(5, 1)))) for i in range(3000)] + [(9001, 0), (9002, 512), (9003, 5000)]
    specs = spark.createDataFrame(SPECS, "spec_id int, capacity_tokens long")
    packed = P.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), specs, shard_pieces=2000)
    rows = packed.collect()
    for spec, capacity in SPECS:
        own = [x for x in rows if x["spec_id"] == spec]
        per: dict = {}
        parts: dict = {}
        for x in own:
            per[x["container_id"]] = per.get(x["container_id"], 0) + x["n_tokens"]
            parts.setdefault(x["doc_id"], []).append((x["start_token"], x["n_tokens"]))
        assert max(per.values()) <= capacity
        for doc, n in sizes:
            at = 0
            for start, k in sorted(parts.get(doc, [])):
                assert start == at
                at += k
            assert at == n
            assert n > capacity or len(parts.get(doc, [])) <= 1
    filled = {x["spec_id"]: x["filled"] for x in P.fill(packed, specs).collect()}
    assert min(filled.values()) > 0.97
    lengths = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    good = {x["spec_id"]: tuple(x)[1:] for x in P.account(packed, lengths, specs).collect()}
    assert good == dict.fromkeys((1, 2), (3002, 0, 0, 0, True))
    broken = packed.where("doc_id <> 9003").unionByName(packed.where("doc_id = 5"))
    assert all(x["n_documents"] == 3001 and x["lost_tokens"] > 0 for x in P.account(broken, lengths, specs).collect())


def test_balanced_costs_and_capacity():
    r = random.Random(7)
    sizes = sorted((r.randint(5, 600) for _ in range(2000)), reverse=True)
    at = P.assign(sizes, 2048)
    assert max(at) + 1 <= 1.01 * P.best_fit_count(sizes, 2048)
    load = [0] * (max(at) + 1)
    for k, n in zip(at, sizes, strict=True):
        load[k] += n
    assert max(load) <= 2048


def test_token_lengths_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "two words"), (2, ""), (3, None), (None, "x"), (1, "two words"), (4, "<|endoftext|>")], "doc_id long, text string")
    got = dict(P.token_lengths(docs).collect())
    assert set(got) == {1, 2, 4} and got[2] == 0 and got[1] == 2 and got[4] > 1
    specs = spark.createDataFrame([], "spec_id int, capacity_tokens long")
    assert P.pack(P.token_lengths(docs), specs).count() == 0
    assert P.pack(P.token_lengths(docs.limit(0)), spark.createDataFrame(SPECS, "spec_id int, capacity_tokens long")).count() == 0
