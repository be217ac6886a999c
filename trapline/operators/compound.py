"""D36 — compound dark-pattern scorer over a scan's raw findings.

Two chained group-bys, (scan, type, category) then scan; both are satisfied
by the hash(scan_id) partitioning of the findings, so no extra shuffle and
no join.  Level one is pre-aggregated, so the per-scan lists hold one entry
per distinct finding type, bounded by the detector vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions import fixed
from trapline.functions.columns import in_list, lookup, round_half_up


def compound_findings(raw: DataFrame, brand: str = fixed.SUMMARY_BRAND) -> DataFrame:
    """Return one COMPOUND DARK PATTERN finding per scan where the weighted
    rule fires.  ``raw`` must be the detector output (erank below the
    compound rank); output has the finding schema."""
    pipeline = raw.where(F.col("erank") < fixed.COMPOUND_RANK)
    verified = pipeline.where(
        ~F.col("severity").isin("INFORMATIONAL", "LOW")
        & (F.col("category") != fixed.COMPOUND_CATEGORY))
    cat_l = F.lower(F.col("category"))
    ml_only = F.lower(F.col("engine")).contains("ml") & ~in_list(cat_l, fixed.COMPOUND_ML_EXEMPT_CATEGORIES)
    weighted = verified.select(
        "scan_id", "type", "pos",
        F.when(ml_only, F.lit(fixed.COMPOUND_CATEGORY_WEIGHTS["ml_signal"]))
        .otherwise(lookup(cat_l, fixed.COMPOUND_CATEGORY_WEIGHTS, 1)).alias("w"),
        F.when(ml_only, F.lit("ml_signal")).otherwise(cat_l).alias("track"),
    )
    # level 1: per (scan, type, track) — pre-aggregated map-side
    lvl1 = weighted.groupBy("scan_id", "type", "track").agg(
        F.sum("w").alias("w"), F.min("pos").alias("p"))
    # level 2: per scan; the collected sets are bounded by the detector
    # vocabulary (distinct finding types / categories), not by row counts
    t = lvl1.groupBy("scan_id").agg(
        F.sum("w").cast("bigint").alias("total_weight"),
        F.size(F.collect_set("track")).cast("bigint").alias("n_categories"),
        F.max(in_list(F.col("track"), fixed.COMPOUND_CRITICAL_CATEGORIES)).alias("high_harm"),
        F.array_sort(F.collect_list(F.struct("p", "type"))).alias("_tp"),
    ).where((F.col("total_weight") >= fixed.COMPOUND_TRIGGER_WEIGHT)
            & (F.col("n_categories") >= fixed.COMPOUND_MIN_CATEGORIES))
    t = t.withColumn("types", F.array_distinct(F.transform("_tp", lambda s: s["type"])))
    conf = round_half_up(
        F.least(F.lit(0.95), F.lit(0.60) + F.lit(0.35) * (F.lit(1.0) - F.exp(-F.col("total_weight") / F.lit(12.0)))), 3)
    return t.select(
        "scan_id",
        F.lit(fixed.COMPOUND_RANK).alias("erank"),
        F.lit(1).cast("bigint").alias("seq"),
        (F.lit(fixed.COMPOUND_RANK).cast("bigint") * F.lit(1 << 40) + F.lit(1)).alias("pos"),
        F.lit("behavioral").alias("engine"),
        F.lit(fixed.COMPOUND_TYPE).alias("type"),
        F.lit(fixed.COMPOUND_CATEGORY).alias("category"),
        F.when(F.col("high_harm"), "CRITICAL").otherwise("HIGH").alias("severity"),
        conf.alias("confidence"),
        F.lit(fixed.COMPOUND_ELEMENT).alias("element"),
        F.concat(F.lit("Weighted score: "), F.col("total_weight").cast("string"), F.lit(" across "),
                 F.col("n_categories").cast("string"), F.lit(" categories. Active vectors: "),
                 F.array_join("types", ", "), F.lit(".")).alias("evidence"),
        F.concat(F.lit(f"{brand} detected "), F.col("n_categories").cast("string"),
                 F.lit(" independent dark pattern categories (weighted score: "),
                 F.col("total_weight").cast("string"), F.lit(") operating together. "),
                 F.lit(fixed.COMPOUND_DESCRIPTION_TAIL)).alias("description"),
        F.lit(fixed.COMPOUND_RECOMMENDATION).alias("recommendation"),
        F.array(*[F.lit(r) for r in fixed.LEGAL_REFS[fixed.COMPOUND_CATEGORY]]).alias("legal_refs"),
        F.lit(False).alias("is_critical"),
    )


def with_compound(raw: DataFrame, brand: str = fixed.SUMMARY_BRAND) -> DataFrame:
    """Raw findings plus the compound findings (the calibration input)."""
    return raw.unionByName(compound_findings(raw, brand))
