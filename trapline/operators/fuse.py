"""F1–F5 — weighted multi-engine fusion.

F1 and F2 are a partial -> final aggregation chain on (scan, category,
engine) then (scan, category); F3 joins the per-category result back to the
findings.  Confidence is never overwritten; fusion results are new columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions import fixed
from trapline.functions.columns import EXACT_SCALE, exact_avg, exact_sum, lookup, micro_units, round_half_up


def engine_weight(engine=None, weights: dict | None = None, default: float = fixed.FUSION_DEFAULT_WEIGHT):
    weights = weights or fixed.FUSION_WEIGHTS
    return lookup(F.col("engine") if engine is None else engine, weights, default)


def category_engine_evidence(findings: DataFrame, weights: dict | None = None) -> DataFrame:
    """max(confidence x engine weight) per (scan, category, engine)."""
    return (findings
            .withColumn("_wc", F.col("confidence") * engine_weight(weights=weights))
            .groupBy("scan_id", "category", "engine").agg(F.max("_wc").alias("weighted")))


def category_fusion(findings: DataFrame, weights: dict | None = None) -> DataFrame:
    """F2: per (scan, category) fusion score and engine count."""
    weights = weights or fixed.FUSION_WEIGHTS
    total = sum(weights.values()) or 1.0
    return (category_engine_evidence(findings, weights)
            .groupBy("scan_id", "category")
            .agg(exact_sum(F.col("weighted")).alias("_s"), F.count(F.lit(1)).alias("engine_count"),
                 F.array_sort(F.collect_list("engine")).alias("fusion_engines"))
            .select("scan_id", "category",
                    F.least(F.lit(1.0), F.col("_s") / F.lit(total)).alias("category_score"),
                    F.col("engine_count").cast("bigint").alias("engine_count"),
                    "fusion_engines"))


def fuse(findings: DataFrame, weights: dict | None = None) -> DataFrame:
    """add engine_count, conf_boost, fusion_confidence, fusion_score,
    fusion_engines to every finding.  F1/F2 are evaluated as windows over
    (scan, category[, engine]) so the findings stay in place (no join back,
    no shuffle on scan_id-partitioned input)."""
    weights = weights or fixed.FUSION_WEIGHTS
    total = sum(weights.values()) or 1.0
    w_ceo = Window.partitionBy("scan_id", "category", "engine").orderBy("pos")
    w_ce = w_ceo.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w_c = Window.partitionBy("scan_id", "category")
    f = (findings
         .withColumn("_m", F.max(F.col("confidence") * engine_weight(weights=weights)).over(w_ce))
         .withColumn("_first", F.row_number().over(w_ceo) == 1))
    f = (f.withColumn("category_score", F.least(F.lit(1.0), F.sum(micro_units(F.when(F.col("_first"), F.col("_m")))).over(w_c).cast("double")
                                                / F.lit(float(EXACT_SCALE)) / F.lit(total)))
         .withColumn("engine_count", F.count(F.when(F.col("_first"), F.lit(1))).over(w_c).cast("bigint"))
         .withColumn("fusion_engines", F.array_sort(F.collect_set("engine").over(w_c)))
         .drop("_m", "_first"))
    boost = (F.when(F.col("engine_count") >= 3, F.lit(0.10))
             .when(F.col("engine_count") >= 2, F.lit(0.05)).otherwise(F.lit(0.0)))
    return (f
            .withColumn("conf_boost", boost)
            .withColumn("fusion_confidence",
                        round_half_up(F.least(F.lit(0.98), F.col("confidence") + F.col("conf_boost")), 3))
            .withColumn("fusion_score", round_half_up(F.col("category_score"), 3))
            .drop("category_score"))


def scan_fusion_score(fused: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """scan-level agreement score; 0 for scans without findings when
    ``scans`` is given (left join from scans)."""
    agg = fused.groupBy("scan_id").agg(
        exact_avg(F.col("fusion_score")).alias("_af"), F.avg("engine_count").alias("_ae"))
    val = round_half_up(F.least(F.lit(1.0), F.col("_af") * F.lit(0.6)
                                + F.least(F.col("_ae") / F.lit(4.0), F.lit(1.0)) * F.lit(0.4)), 3)
    agg = agg.select("scan_id", val.alias("fusion_scan_score"))
    if scans is None:
        return agg
    return (scans.select("scan_id").join(agg, "scan_id", "left")
            .select("scan_id", F.coalesce("fusion_scan_score", F.lit(0.0)).alias("fusion_scan_score")))


def weighted_signal_mean(df: DataFrame, group_cols, signal_col: str, weight_col: str) -> DataFrame:
    """sum(s*w)/sum(w) clamped to [0, 1], 3 dp; 0 when empty or zero weight."""
    s = F.col(signal_col)
    w = F.col(weight_col)
    agg = df.groupBy(*group_cols).agg(exact_sum(s * w).alias("_sw"), exact_sum(w).alias("_w"))
    v = F.when(F.col("_w") > 0,
               round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_sw") / F.col("_w"))), 3)
               ).otherwise(F.lit(0.0))
    return agg.select(*group_cols, v.alias("signal_mean"))
