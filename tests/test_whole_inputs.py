"""Queries on small tables of which a part is easily left out."""

import datetime as dt

import numpy as np
import pytest

from quillon.plans import image_queries, package_queries, provenance_queries, screen_queries

SUMMARY = "row_id long, package_root string, figure_file string, comparison string, mean string, sd string, sem string, n string, p_value string, ingested_at timestamp"
FIELDS = "row_id long, package_root string, figure_file string, animal_id string, field_id string, value string, reported_n_basis string, ingested_at timestamp"
T = dt.datetime(2026, 1, 1)


@pytest.fixture
def write(spark, tmp_path):
    def run(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return run


def test_sequences_are_compared_whole_and_in_every_column(spark, write):
    """Sequences that agree in five values only are no reuse; equal ones are. Summary columns don't count."""
    rows = [(10 * f + k, "p", f"f{f}.csv", "c", f"{k}.{1 if f < 2 else f}5", f"{f}{k}.5", f"{f}.{k}", "8" if k < 5 else str(8 + f), None, T) for f in range(3) for k in range(7)]
    write("figure_7_summary", rows, SUMMARY)
    write("lineitem", [(o, k, float(q)) for o, qs in ((1, (1, 2, 3, 4, 5)), (2, (1, 2, 3, 4, 5)), (3, (1, 2, 3, 4, 5, 9)), (4, (1, 2, 3, 4, 5, 8))) for k, q in enumerate(qs)], "l_orderkey long, l_linenumber int, l_quantity double")
    d = write("figure_6_field_measurements", [(100 + 10 * f + k, "p", f"m{f}.csv", "a", "b", f"{k * k}.25", "animals", T) for f in range(2) for k in range(6)], FIELDS)
    found = sorted(tuple(r) for r in screen_queries.a25_sequence_reuse(spark, d).collect())
    assert found == [(5, 2, 2, "order-1:quantity"), (6, 2, 2, "p/m0.csv:value")]


FILES = "audit_id string, package_root string, snapshot_no int, created_at timestamp, path string, sha256 string, size_bytes long, role string, received_at timestamp"
LINKS = "row_id long, package_root string, snapshot_no int, figure_panel string, source_record string, relation_type string, modality string, notes string, created_at timestamp, ingested_at timestamp"


def test_every_reference_of_an_assembly_row_is_a_link(spark, write):
    paths = ("figures/a.png", "figures/b.png", "raw_images/r.tif", "raw_images/s.tif")
    write("file_hash_manifest", [("x", "p", 1, T, x, "00", 1, None, T) for x in paths], FILES)
    links = [
        (1, "figures/a.png", "raw_images/r.tif; s.tif | gone.tif;n/a", "chart"),
        (2, "figures/a.png|figures/b.png", ".\\raw_images\\r.tif;raw_images/r.tif", "blot"),
        (3, "figures/b.png", None, "blot"),
        (4, "none", "raw_images/r.tif;raw_images/s.tif", "blot"),
    ]
    d = write("assembly_manifest", [(k, "p", 1, f, s, "declared_derived_from", m, None, T, T) for k, f, s, m in links], LINKS)
    run = lambda n: sorted((tuple(r) for r in (package_queries.QUERIES | provenance_queries.QUERIES)[n](spark, d).collect()), key=repr)
    a, b, r, s = paths
    assert run("j09_assembly_files") == sorted([(1, a, r), (1, a, s), (1, a, None), (2, a, r), (2, b, r), (3, b, None), (4, None, r), (4, None, s)], key=repr)
    assert run("j07_graph_edges") == [("p", 3, 2, 2)]
    assert run("j07_graph_warnings") == [("p", 8, 2, 2)]
    assert run("prov05_modality_routing") == [("p", a, "chart,western_blot", "conflict"), ("p", b, "western_blot", "scan")]
    traced = [(1, a, r, "chart"), (1, a, s, "chart"), (2, a, r, "western_blot"), (2, b, r, "western_blot")]
    assert run("prov01_link_validation") == [(k, f, x, "declared_derived_from", m, "expected_traceability", 0.98) for k, f, x, m in traced]


def test_tiles_with_unlike_signs_meet(spark, write):
    """Noisy copies of images, against all pairs of tiles."""
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (5, 64))
    images = np.concatenate([base + rng.normal(0, noise, base.shape) for noise in (0, 0.08, 0.12)])
    ids = [10 * k + 1 for k in range(len(images))]  # no image is added turned
    d = write("embeddings", [(i, v.tolist(), 0) for i, v in zip(ids, images, strict=True)], "vec_id long, embedding array<double>, label int")
    px = np.floor(images * 1000).reshape(-1, 8, 8)
    tiles = [[p[y : y + 4, x : x + 4].ravel() for y in (0, 2, 4) for x in (0, 2, 4)] for p in px]
    want, unlike = {}, 0
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            for a in tiles[i]:
                for b in tiles[j]:
                    u, v = a - a.mean(), b - b.mean()
                    c, h = u @ v / np.sqrt(u @ u * (v @ v)), int(((u > 0) != (v > 0)).sum())
                    if c >= 0.985 and h <= image_queries.TILE_THRESHOLD:
                        n, best = want.get((ids[i], ids[j]), (0, 0.0))
                        want[ids[i], ids[j]], unlike = (n + 1, max(best, c)), unlike + (h > 0)
    assert unlike > 20
    got = {(r[0], r[1]): (r[2], r[3]) for r in image_queries.QUERIES["j03_tiles_across"](spark, d).collect()}
    assert got == {k: (n, pytest.approx(c, abs=2e-6)) for k, (n, c) in want.items()}


def test_images_near_by_the_perceptual_hash_only(spark, write):
    """A strong ramp turns most bits of the other hashes, but few frequencies."""
    from quillon.operators.images import perceptual_bits

    rng = np.random.default_rng(11)
    base = rng.normal(0, 1, (8, 8))
    images = [base, base + np.linspace(-9, 9, 8)[None], rng.normal(0, 1, (8, 8))]
    d = write("embeddings", [(k + 1, x.ravel().tolist(), 0) for k, x in enumerate(images)], "vec_id long, embedding array<double>, label int")
    px = np.floor(np.array(images) * 1000)
    p = perceptual_bits(px.repeat(4, 1).repeat(4, 2))
    average = [x >= x.mean() for x in px]
    assert (average[0] != average[1]).sum() > 6 and ((np.diff(px[0]) < 0) != (np.diff(px[1]) < 0)).sum() > 6
    distance = int(p[0] ^ p[1]).bit_count()
    assert distance <= image_queries.THRESHOLD
    assert [tuple(r) for r in image_queries.QUERIES["j02_near_images"](spark, d).collect()] == [(1, 2, "identity", distance)]
    assert {tuple(r) for r in image_queries.QUERIES["g01_image_clusters"](spark, d).collect()} == {(1, 1), (2, 1)}
