from quillon.operators import provenance as P
from quillon.operators import text as T

FILES = [("p", f) for f in ("figures/fig_2b.png", "figures/fig_3a.png", "figures/fig_4.png", "raw_images/rawscan.tif", "source_data/table9.csv")] + [("q", "figures/fig_2b.png")]


def files(spark):
    return spark.createDataFrame(FILES, "package_root string, path string")


def links(spark, rows):
    shape = "row_id int, package_root string, figure_panel string, source_record string, relation_type string, modality string"
    return P.structured_links(spark.createDataFrame([(i, "p", *r) for i, r in enumerate(rows)], shape), files(spark))


def test_links_and_what_they_assert(spark):
    rows = [
        ("Fig_2b.png; figures/fig_3a.png", "(rawscan.tif)", None, "WB"), ("fig_4.png", "figures/fig_3a.png", "Same_Field_Different_Channel", "line chart"), ("fig_4.png", "figures/fig_3a.png", "declared_same_source", None),
        ("fig_4.png", "rawscan.tif", "cropped_from", None), ("rawscan.tif", "table9.csv", None, None), ("fig_4.png", "none", None, None), (None, "rawscan.tif", None, None), ("fig_4.png", "other/folder.tif", None, None),
    ]
    got = sorted((r["row_id"], r["figure"], r["source"], r["effect"], r["confidence"], r["modality"]) for r in links(spark, rows).collect())
    assert got == [
        (0, "figures/fig_2b.png", "raw_images/rawscan.tif", "expected_traceability", 0.98, "western_blot"), (0, "figures/fig_3a.png", "raw_images/rawscan.tif", "expected_traceability", 0.98, "western_blot"),
        (1, "figures/fig_4.png", "figures/fig_3a.png", "expected_traceability", 0.98, "chart"), (2, "figures/fig_4.png", "figures/fig_3a.png", "candidate_traceability", 0.5, "other"),
        (3, "figures/fig_4.png", "raw_images/rawscan.tif", "unsupported_relation", 0.0, "other"),
    ]


def test_edges_in_context(spark):
    own = links(spark, [("fig_2b.png", "rawscan.tif", None, None), ("fig_4.png", "figures/fig_3a.png", "same_membrane_reprobe", None)])
    a, b, c, r = "figures/fig_2b.png", "figures/fig_3a.png", "figures/fig_4.png", "raw_images/rawscan.tif"
    rows = [(a, r, "global"), (b, r, "global"), (c, b, "global"), (b, c, "local_patch"), (a, b, "global"), (a, c, "local_patch"), (a, a, "local_patch"), (r, "source_data/table9.csv", "global")]
    edges = spark.createDataFrame([("p", f"e{i}", *x) for i, x in enumerate(rows)], "package_root string, edge_id string, left string, right string, scope string")
    texts = spark.createDataFrame([
        ("p", "m.txt", "Figure 2B and Figure 3A show the same loading control, which was reused as we disclose."), ("p", "n.txt", "fig 2b " + "x " * 400 + "fig 4, we disclose that it was reused"),
        ("q", "o.txt", "Figure 2b and figure 4: intentionally reused"), ("p", "z", None),
    ], "package_root string, segment string, text string")
    told = P.disclosures(edges, texts)
    assert {x["edge_id"] for x in told.collect()} == {"e4", "e6"}
    context = P.contexts(texts, files(spark))
    got = {x["edge_id"]: x["tag"] for x in P.classify_edges(edges, own, told, context).collect()}
    assert got == {
        "e0": "expected_traceability", "e1": "unresolved_fig_raw_similarity", "e2": "manifest_conflict", "e3": "declared_local_patch_requires_verification", "e4": "disclosed_legitimate_reuse",
        "e5": "local_patch_cross_context", "e6": "same_image_copy_move", "e7": "unresolved_similarity",
    }
    made = P.candidates(P.classify_edges(edges, own, told, context), ["package_root"]).collect()
    assert [(x["kind"], x["risk"], x["n_edges"], x["n_positive"]) for x in made] == [("local_patch_reuse", "R1_max", 5, 1)]
    assert [tuple(x) for x in P.positive_rows(P.classify_edges(edges, own, told, context)).collect()] == [("p", "PROV-0001", a, r)]
    seen = {x["package_root"]: x["tag"] for x in context.collect()}
    assert seen == {"p": "disclosed_unjustified_reuse", "q": "disclosed_unjustified_reuse"}
    assert P.classify_edges(edges.limit(0), own, told, context).count() == 0


def test_routes_and_prose(spark):
    own = links(spark, [("fig_2b.png", "rawscan.tif", None, "chart"), ("fig_3a.png", "rawscan.tif", None, "chart"), ("fig_3a.png", "table9.csv", None, "blot"), ("fig_4.png", "rawscan.tif", None, "photo")])
    assert {x["figure"][-8:]: x["route"] for x in P.routing(own).collect()} == {"g_2b.png": "exclude", "g_3a.png": "conflict", "ig_4.png": "scan"}
    lines = spark.createDataFrame([("p", "a.txt", 1, "fig_2b.png comes from rawscan.tif and table9.csv."), ("p", "a.txt", 2, "fig_4.png, nothing else"), ("p", "a.txt", 3, None)], "package_root string, file string, line_no int, line string")
    assert sorted((x["figure"], x["source"]) for x in P.prose_links(lines, files(spark)).collect()) == [("figures/fig_2b.png", "raw_images/rawscan.tif"), ("figures/fig_2b.png", "source_data/table9.csv")]


def test_kinds_of_overlap(spark):
    rows = [
        ("methods", "results", "m", "m", "x", "y", 0.9), ("results", None, "thesis", "m", "from my thesis", "y", 0.9), ("results", "results", "thesis", "m", "x", "y", 0.46), ("results", "results", "m", "m", "x", "y", 0.4),
        ("abstract", None, "m", None, None, "y", 0.5), ("abstract", "intro", "m", "m", "we disclosed it", "y", 0.6), (None, None, None, None, None, None, 0.9),
    ]
    shape = "left_section string, right_section string, left_category string, right_category string, left_text string, right_text string, similarity double"
    got = [(x["kind"], x["risk"]) for x in T.classify_overlap(spark.createDataFrame(rows, shape).coalesce(1)).collect()]
    plain = ("text_overlap_candidate", "R2_possible")
    high = ("text_overlap_candidate", "R3_possible")
    assert got == [("methods_boilerplate_overlap", "R2_max"), ("self_overlap_candidate", "R2_max"), high, plain, high, plain, plain]


def test_readiness(spark):
    text = "Fig. 2 has 3.14 units. TODO: see figure 3b! " + "word " * 44 + "end. 中文句子。\nReferences\n10.1000/ABC.5, and https://doi.org/10.1000/abc.5 too (10.5555/x)."
    df = spark.createDataFrame([(1, text), (1, text), (2, ""), (3, None), (4, "10.1234/z no list")], "doc_id int, text string")
    got = {x["doc_id"]: x for x in T.readiness(df, "doc_id").collect()}
    assert set(got) == {1, 2, 4}
    one = got[1]
    assert (one["n_long"], one["placeholders"], one["figure_refs"], one["has_references"], one["dois"]) == (1, ["TODO"], ["2", "3b"], True, ["10.1000/abc.5", "10.5555/x"])
    assert one["language_status"] == "needs_attention" and one["reference_status"] == "ready_for_manual_review"
    assert (got[2]["n_sentences"], got[2]["n_words"], got[2]["reference_status"]) == (0, 0, "needs_attention") and got[4]["dois"] == ["10.1234/z"]
