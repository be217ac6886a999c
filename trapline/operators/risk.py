"""K1–K4 — final risk assessment per scan (a single group-by on scan_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions import fixed
from trapline.functions.columns import EXACT_SCALE, lookup, micro_units, round_half_up


def risk_assessment(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """K1–K4 over validated findings (needs severity, confidence, category,
    fusion_score).  With ``scans`` every scan gets a row (empty -> 0 / LOW)."""
    sev_score = lookup(F.col("severity"), fixed.RISK_SEVERITY_SCORES, fixed.RISK_UNKNOWN_SEVERITY_SCORE)
    fusion = F.coalesce(F.col("fusion_score"), F.lit(0.5))
    contrib = sev_score * F.col("confidence") * (F.lit(0.7) + F.lit(0.3) * fusion)
    # one pass over the findings: a row per (scan, category, severity), whose lists per
    # scan are bounded by the vocabulary
    cells = findings.groupBy("scan_id", "category", "severity").agg(
        F.sum(micro_units(contrib)).alias("u"), F.count(F.lit(1)).alias("n"))
    per_scan = cells.where(F.col("scan_id").isNotNull()).groupBy("scan_id").agg(
        (F.sum("u").cast("double") / F.lit(float(EXACT_SCALE))).alias("total_risk"),
        F.sum("n").cast("bigint").alias("finding_count"),
        F.collect_set("category").alias("_cats"),
        F.collect_set("severity").alias("_sevs"),
        F.collect_list(F.struct("category", "severity", "n")).alias("_cells"),
    )

    def distribution(names: str, field: str):
        def label(v):
            n = F.aggregate(F.filter("_cells", lambda x: x[field] == v), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
            return F.concat(v, F.lit(":"), n.cast("string"))
        return F.array_join(F.array_sort(F.transform(names, label)), ",")
    bonus = reduce(lambda acc, rule: F.greatest(acc, F.when(
        F.array_contains("_cats", rule[0]) & F.array_contains("_cats", rule[1]), F.lit(rule[2])
    ).otherwise(F.lit(1.0))), fixed.RISK_COMPOUND_PAIRS, F.lit(1.0))
    k = (per_scan.withColumn("compound_bonus", bonus)
         .withColumn("severity_distribution", distribution("_sevs", "severity"))
         .withColumn("category_distribution", distribution("_cats", "category")))
    norm = F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                                          F.lit(1.0) - F.exp(-(F.col("total_risk") * F.col("compound_bonus")) / F.lit(3.0))))
    k = k.withColumn("_norm", norm)
    level = F.when(F.col("_norm") >= fixed.RISK_SCORE_BANDS[0][0], fixed.RISK_SCORE_BANDS[0][1])
    label = F.when(F.col("_norm") >= fixed.RISK_SCORE_BANDS[0][0], fixed.RISK_SCORE_BANDS[0][2])
    for thr, lv, lb in fixed.RISK_SCORE_BANDS[1:]:
        level = level.when(F.col("_norm") >= thr, lv)
        label = label.when(F.col("_norm") >= thr, lb)
    k = k.select("scan_id", "finding_count", "compound_bonus",
                 round_half_up(F.col("_norm"), 3).alias("risk_score"),
                 level.otherwise(fixed.RISK_SCORE_FLOOR[0]).alias("risk_level"),
                 label.otherwise(fixed.RISK_SCORE_FLOOR[1]).alias("risk_label"),
                 "severity_distribution", "category_distribution")
    if scans is None:
        return k
    return (scans.select("scan_id").join(k, "scan_id", "left").select(
        "scan_id",
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("risk_level", F.lit(fixed.RISK_SCORE_FLOOR[0])).alias("risk_level"),
        F.coalesce("risk_label", F.lit(fixed.RISK_SCORE_FLOOR[1])).alias("risk_label"),
        F.coalesce("finding_count", F.lit(0).cast("bigint")).alias("finding_count"),
        F.coalesce("compound_bonus", F.lit(1.0)).alias("compound_bonus"),
        F.coalesce("severity_distribution", F.lit("")).alias("severity_distribution"),
        F.coalesce("category_distribution", F.lit("")).alias("category_distribution"),
    ))
