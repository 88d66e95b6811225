"""Screens a package's tables and calibrates what they suggest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import screens as S
from quillon.plans.package_queries import MODES, calibrated
from quillon.session import materialise
from quillon.sources import files

Detector = Callable[[DataFrame], DataFrame]
CANDIDATE = "detector string, location string, tag string, suggestion string, strength string, complete boolean"


def _candidate(df: DataFrame, name: str, location, tag: str) -> DataFrame:
    return df.select(F.lit(name).alias("detector"), location.alias("location"), F.lit(tag).alias("tag"), F.lit("R2_max").alias("suggestion"), F.lit("weak_signal").alias("strength"), F.lit(True).alias("complete"))


def _column(name: str, tag: str, screen: Detector) -> Detector:
    return lambda cells: _candidate(screen(cells).where("flagged"), name, F.concat_ws(":", "table_id", "col"), tag)


#: Detectors over numeric cells; others can be given to AuditSession.
DETECTORS: dict[str, Detector] = {
    "terminal_digits": _column("terminal_digits", "terminal_digit", S.terminal_digits),
    "rounding": _column("rounding", "weak_forensic_triage_signal", S.rounding),
    "p_clusters": _column("p_clusters", "p_value_clustering", S.p_clusters),
    "precision": lambda cells: _candidate(S.precision_mix(cells).where("mixed or differs"), "precision", F.concat_ws(":", "table_id", "col"), "precision_mixing"),
    "benford": lambda cells: _candidate(S.benford(cells).where("flagged"), "benford", F.col("table_id"), "benford_style"),
}


class AuditSession:
    """Runs detectors over a package folder. One that fails gives a coverage gap instead of ending the audit."""

    def __init__(self, spark: SparkSession, detectors: dict[str, Detector] | None = None):
        self.spark, self.detectors = spark, DETECTORS if detectors is None else detectors

    def candidates(self, root: str) -> DataFrame:
        cells = materialise(S.numeric_cells(files.delimited(self.spark, root).withColumnRenamed("file", "table_id")), "cells")
        found, gaps = self.spark.createDataFrame([], CANDIDATE), []
        for name, detect in self.detectors.items():
            try:
                found = found.unionByName(materialise(detect(cells), name))
            except Exception as e:  # whatever a detector raises is a gap in what was screened
                gaps.append((name, f"{type(e).__name__}: {str(e)[:200]}", "detector_execution_failure", "R1_max", "weak_signal", True))
        if cells.isEmpty():
            gaps.append(("tables", root, "audit_coverage_gap", "R1_max", "weak_signal", True))
        unread = files.gaps(files.inventory(self.spark, root)).select(
            F.lit("inventory").alias("detector"), F.concat_ws(": ", "path", "reason").alias("location"), F.lit("audit_coverage_gap").alias("tag"),
            F.lit("R1_max").alias("suggestion"), F.lit("weak_signal").alias("strength"), F.lit(True).alias("complete"),
        )
        return found.unionByName(unread).unionByName(self.spark.createDataFrame(gaps, CANDIDATE))

    def run(self, root: str, mode: str = "internal_presubmission") -> DataFrame:
        """(id, detector, location, tag, suggested, risk) of every candidate, calibrated."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode}")
        rows = self.candidates(root).withColumn("id", F.concat_ws("-", "detector", F.left(F.sha2(F.concat_ws("|", "detector", "location", "tag"), 256), F.lit(12)))).distinct()
        rows = materialise(rows, "candidates")
        risks = calibrated(rows.select("id", F.lit(mode).alias("mode"), "tag", "suggestion", "strength", F.col("tag").alias("tag2"), "complete"))
        return rows.join(risks, "id").select("id", "detector", "location", "tag", "suggested", "risk")
