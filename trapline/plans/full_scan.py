"""P1 / P2 — the findings → report plan over whole tables.

Stage layout: raw findings are hash-partitioned on scan_id once; every later
window and group-by is keyed by scan_id first, so Catalyst reuses that
partitioning instead of re-shuffling per step.  Smoothing then shuffles
once by domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions import fixed
from trapline.operators import calibrate as H
from trapline.operators import consensus as A
from trapline.operators import fuse as Fu
from trapline.operators import report as R
from trapline.operators import risk as K
from trapline.operators import temporal as T
from trapline.operators.compound import with_compound
from trapline.session import dealt_by_key, discard, materialize, scratch_tables


# what consensus, report, risk and funnel read of a written stage
FUSED_FIELDS = ["scan_id", "pos", "engine", "type", "category", "severity", "confidence", "element", "evidence",
                "recommendation", "legal_refs", "is_critical", "note", "engine_count", "fusion_score"]
VALIDATED_FIELDS = ["scan_id", "engine", "type", "category", "severity", "confidence", "recommendation", "legal_refs",
                    "fusion_score", "cat_first", "rank_in_category"]


@dataclass
class ScanRun:
    raw: DataFrame          # detector findings + compound (calibration input)
    calibrated: DataFrame   # H1–H5
    fused: DataFrame        # F3
    validated: DataFrame    # A1–A11
    reports: DataFrame      # one row per scan


def run_findings(scans: DataFrame, detector_findings: DataFrame, brand: str = fixed.SUMMARY_BRAND,
                 partitions: int | None = None, materialize_stages: bool = True,
                 hashed: bool = False) -> ScanRun:
    """D36 → H → F → A → R → K → funnel counts → T2 smoothing.

    ``hashed``: the findings lie hashed on scan_id already.  A caller that reads one
    table of the run takes ``materialize_stages=False``: nothing is written, and the
    columns that table does not need never enter the windows.  Otherwise the tables
    from fusion on hold the columns that a report needs."""
    def rehash(df):
        return df.repartition(partitions, "scan_id") if partitions else df.repartition("scan_id")

    f = detector_findings if hashed else rehash(detector_findings)
    # hashed anew: a union does not keep its sides' partitioning through AQE
    raw = rehash(with_compound(f, brand))
    def cut(df, name, columns):
        # written table in the shared checkpoint dir, re-hashed on scan_id so
        # every later window / aggregate / join reuses that partitioning
        if not materialize_stages:
            return df
        t = materialize(df.select(*columns), name)
        return t.repartition(partitions, "scan_id") if partitions else dealt_by_key(t, "scan_id")

    cal = H.calibrate(raw)
    fused = cut(Fu.fuse(cal), "fused-findings", FUSED_FIELDS)  # feeds consensus, funnel, scan fusion score
    cal = fused
    validated = cut(A.aggregate(fused, scans), "validated-findings", VALIDATED_FIELDS)  # report, risk, funnel
    reports = R.scan_reports(validated, scans, brand)
    risk = K.risk_assessment(validated).select(
        "scan_id", "risk_score", F.col("risk_level").alias("assessed_risk_level"), "compound_bonus")
    funnel = _funnel(f, raw, cal, validated)
    fscore = Fu.scan_fusion_score(fused)
    out = (reports.join(risk, "scan_id", "left").join(funnel, "scan_id", "left")
           .join(fscore, "scan_id", "left"))
    zero = F.lit(0).cast("bigint")
    out = out.select(
        *[c for c in out.columns if c not in (
            "risk_score", "assessed_risk_level", "compound_bonus", "fusion_scan_score",
            "raw_findings", "behavioral_findings", "after_calibration", "after_aggregation",
            "critical_boosted", "calibration_upgraded", "calibration_downgraded")],
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("assessed_risk_level", F.lit(fixed.RISK_SCORE_FLOOR[0])).alias("assessed_risk_level"),
        F.coalesce("compound_bonus", F.lit(1.0)).alias("compound_bonus"),
        F.coalesce("fusion_scan_score", F.lit(0.0)).alias("fusion_scan_score"),
        *[F.coalesce(c, zero).alias(c) for c in (
            "raw_findings", "behavioral_findings", "after_calibration", "after_aggregation",
            "critical_boosted", "calibration_upgraded", "calibration_downgraded")],
    )
    out = (out.withColumn("dropped_by_calibration", F.col("raw_findings") - F.col("after_calibration"))
           .withColumn("dropped_by_filter", F.col("after_calibration") - F.col("after_aggregation")))
    return ScanRun(raw, cal, fused, validated, out)


def _funnel(detector: DataFrame, raw: DataFrame, cal: DataFrame, validated: DataFrame) -> DataFrame:
    """Per-stage counts per scan."""
    r = raw.groupBy("scan_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("raw_findings"),
        F.count_if(F.col("erank") == fixed.COMPOUND_RANK).cast("bigint").alias("behavioral_findings"))
    c = cal.groupBy("scan_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("after_calibration"),
        F.count_if(F.col("is_critical")).cast("bigint").alias("critical_boosted"),
        F.count_if(F.col("note").contains("Upgraded")).cast("bigint").alias("calibration_upgraded"),
        F.count_if(F.col("note").contains("Downgraded")).cast("bigint").alias("calibration_downgraded"))
    v = validated.groupBy("scan_id").agg(F.count(F.lit(1)).cast("bigint").alias("after_aggregation"))
    return r.join(c, "scan_id", "left").join(v, "scan_id", "left")


def smoothed_reports(reports: DataFrame, scans: DataFrame, partitions: int | None = None) -> DataFrame:
    """T1/T2 then grade and risk level recomputed from the smoothed score.  The
    reports are written: the shuffles of their stages are gone before that by domain."""
    base = materialize(reports.join(scans.select("scan_id", "scan_ts"), "scan_id"), "scan-reports")
    sm = T.smooth_trust(base, key="domain", order=("scan_ts", "scan_id"), score="trust_score",
                        num_partitions=partitions)
    return (sm.withColumnRenamed("trust_score", "trust_score_raw")
            .withColumnRenamed("smoothed_score", "trust_score")
            .withColumn("grade", R.grade(F.col("trust_score")))
            .withColumn("risk_level", R.risk_level(F.col("trust_score")))
            .withColumn("risk_label", R.risk_label(F.col("trust_score")))
            .drop("scan_ts"))


def full_scan(scans: DataFrame, detector_findings: DataFrame, partitions: int | None = None,
              hashed: bool = False) -> DataFrame:
    """P1 end to end: one report row per scan, trust score smoothed per
    domain.  The findings are read three times (calibration, compound scorer,
    funnel): findings that are dear to make should come as a written table."""
    before = set(scratch_tables())
    run = run_findings(scans, detector_findings, partitions=partitions, hashed=hashed)
    out = smoothed_reports(run.reports, scans, partitions)
    # the reports are written: the tables they were made of are no longer read
    discard(scans.sparkSession, [t for t in scratch_tables() if t not in before], out)
    return out


QUICK_ENGINES = ["dom", "cookie", "advanced"]


def quick_scan(scans: DataFrame, detector_findings: DataFrame) -> DataFrame:
    """Dom + cookie + advanced only, calibrate → fuse → aggregate;
    findings only (no compound scorer, report or score)."""
    # written once: its row count sets how many tasks share the windows' sorts
    f = dealt_by_key(materialize(detector_findings.where(F.col("engine").isin(*QUICK_ENGINES)), "quick-findings"), "scan_id")
    return A.aggregate(Fu.fuse(H.calibrate(f)), scans)
