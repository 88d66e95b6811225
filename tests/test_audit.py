import numpy as np
import pytest

from quillon.audit import DETECTORS, AuditSession
from quillon.operators import images


def test_audit_of_a_folder(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,value\n" + "".join(f"a{i},{i}.5\n" for i in range(12)))
    (tmp_path / "scan.png").write_bytes(b"x")

    def fails(cells):
        raise RuntimeError("no")

    found = AuditSession(spark, DETECTORS | {"broken": fails}).run(f"file://{tmp_path}", "external_public_material").collect()
    got = {(r["detector"], r["tag"], r["risk"]) for r in found}
    assert ("terminal_digits", "terminal_digit", "R2") in got and ("broken", "detector_execution_failure", "R1") in got
    assert len({r["id"] for r in found}) == len(found)
    with pytest.raises(ValueError):
        AuditSession(spark).run(f"file://{tmp_path}", "no such mode")


def test_audit_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert [(r["tag"], r["risk"]) for r in AuditSession(spark).run(f"file://{tmp_path}").collect()] == [("audit_coverage_gap", "R1")]


def test_perceptual_hashes(spark):
    rng = np.random.default_rng(0)
    px = rng.integers(0, 255, (3, 8, 8))
    df = spark.createDataFrame([(i, [int(v) for v in m.ravel()]) for i, m in enumerate(px)] + [(9, None), (10, [1, 2])], "id int, px array<int>")
    got = dict(images.perceptual_hashes(df).collect())
    assert set(got) == {0, 1, 2}
    big = px[0].repeat(4, 0).repeat(4, 1)
    low = [sum(big[x, y] * np.cos(np.pi * k * (2 * x + 1) / 64) * np.cos(np.pi * m * (2 * y + 1) / 64) for x in range(32) for y in range(32)) for k in range(8) for m in range(8)][1:]
    want = int("".join("1" if v >= sorted(low)[31] else "0" for v in low), 2)
    assert bin(got[0] ^ want).count("1") <= 1  # one value may tie with the median
    stretched = images.contrast(px)
    assert stretched.min() == 0 and stretched.max() == 255 and (images.contrast(np.full((1, 2, 2), 7)) == 7).all()
