"""H1–H6 — impact / intent calibration and the decision gate.

All per-finding rules are one projection (CASE chains); the only grouping
is the multi-signal gate (H4), a pre-aggregated count per (scan, category)
joined back on its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions import fixed
from trapline.functions.columns import contains_any, in_list


def score(findings: DataFrame) -> DataFrame:
    """H1: attach impact, intent and the critical flag."""
    cat = F.col("category")
    findings = findings.withColumn("_type_l", F.lower(F.col("type")))
    type_l = F.col("_type_l")
    trigger = contains_any(type_l, fixed.CRITICAL_TYPE_TRIGGERS)
    impact = (F.when(trigger, "HIGH")
              .when(in_list(cat, fixed.HIGH_IMPACT_CATEGORIES), "HIGH")
              .when(in_list(cat, fixed.MEDIUM_IMPACT_CATEGORIES), "MEDIUM")
              .otherwise("LOW"))
    is_crit = F.coalesce(F.col("is_critical"), F.lit(False)) | trigger
    out = findings.withColumn("impact", impact).withColumn("is_critical", is_crit)
    intent = (F.when(in_list(F.col("type"), fixed.STRONG_INTENT_TYPES)
                     | in_list(cat, fixed.STRONG_INTENT_CATEGORIES)
                     | F.col("is_critical"), "STRONG")
              .when(F.col("severity").isin("HIGH", "CRITICAL") | (F.col("impact") == "HIGH"), "MODERATE")
              .otherwise("WEAK"))
    return out.withColumn("intent", intent)


def is_weak(engine=None, type_=None, severity=None, impact=None):
    """H3: weak-signal predicate."""
    engine = F.col("engine") if engine is None else engine
    t = F.col("_type_l") if type_ is None else F.lower(type_)
    sev = F.col("severity") if severity is None else severity
    imp = F.col("impact") if impact is None else impact
    return (((engine == "ml") & (imp == "LOW"))
            | contains_any(t, fixed.WEAK_SIGNAL_FRAGMENTS)
            | ((engine == "readability") & t.contains("jargon") & (sev == "MEDIUM")))


def decide(scored: DataFrame) -> DataFrame:
    """H2: keep/drop, severity rewrite and note, in rule order."""
    conf = F.col("confidence")
    sev = F.col("severity")
    imp = F.col("impact")
    intent = F.col("intent")
    c_crit = F.col("is_critical") & (conf >= fixed.CONF_CRITICAL)
    c_info = sev == "INFORMATIONAL"
    threshold = F.when(imp == "HIGH", F.lit(fixed.CONF_HIGH_IMPACT)).otherwise(F.lit(fixed.CONF_DEFAULT))
    dropped = is_weak() | (conf < threshold) | (imp == "LOW")
    keep = c_crit | c_info | ~dropped
    down = (imp == "MEDIUM") & (intent == "WEAK")
    up = (imp == "HIGH") & (intent == "STRONG")
    new_sev = (F.when(c_crit & ~sev.isin("CRITICAL", "HIGH"), "CRITICAL")
               .when(c_crit | c_info, sev)
               .when(down & sev.isin("HIGH", "CRITICAL"), "MEDIUM")
               .when(down, sev)
               .when(up & sev.isin("LOW", "MEDIUM"), "HIGH")
               .otherwise(sev))
    note = (F.when(c_crit, fixed.NOTE_CRITICAL)
            .when(c_info, fixed.NOTE_INFORMATIONAL)
            .when(down, fixed.NOTE_DOWNGRADED)
            .when(up, fixed.NOTE_UPGRADED)
            .otherwise(F.concat(F.lit(fixed.NOTE_ACCEPTED_PREFIX), imp, F.lit(" impact / "), intent,
                                F.lit(" intent"))))
    return (scored.where(keep)
            .withColumn("raw_severity", sev)
            .withColumn("note", note)
            .withColumn("severity", new_sev)
            .drop("_type_l"))


def multi_signal_gate(decided: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """H4: urgency / social_proof / nagging need >= 2 findings per scan.
    A count over the (scan, category) window: no shuffle when the input is
    already partitioned by scan_id.  ``order`` is the order that the rows of a
    window are left in, for a later window to use."""
    multi = in_list(F.col("category"), fixed.MULTI_SIGNAL_CATEGORIES)
    w = Window.partitionBy("scan_id", "category")
    if order:
        w = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(w)
    return decided.withColumn("_n", n).where(~multi | (F.col("_n") >= 2)).drop("_n")


def recalibrate(gated: DataFrame) -> DataFrame:
    """H5: final severity alignment (critical overrides untouched)."""
    sev = F.col("severity")
    imp = F.col("impact")
    intent = F.col("intent")
    free = ~F.col("note").contains("Critical override")
    to_high = free & (imp == "HIGH") & intent.isin("STRONG", "MODERATE") & sev.isin("LOW", "MEDIUM")
    to_med = free & (imp == "MEDIUM") & (intent == "WEAK") & sev.isin("CRITICAL", "HIGH")
    return (gated
            .withColumn("note", F.when(to_high, F.concat(F.col("note"), F.lit(fixed.NOTE_RECAL_HIGH)))
                        .when(to_med, F.concat(F.col("note"), F.lit(fixed.NOTE_RECAL_MEDIUM)))
                        .otherwise(F.col("note")))
            .withColumn("severity", F.when(to_high, "HIGH").when(to_med, "MEDIUM").otherwise(sev)))


def calibrate(findings: DataFrame) -> DataFrame:
    """H1–H5 in one chain.  Adds impact, intent, note, raw_severity and the
    updated is_critical flag; confidence is never modified."""
    # fusion's windows need (engine, pos) within (scan, category): one sort serves both
    order = ("engine", "pos") if "pos" in findings.columns else ()
    return recalibrate(multi_signal_gate(decide(score(findings)), order))


def calibration_stats(raw: DataFrame, calibrated: DataFrame) -> DataFrame:
    """H6: per-scan counts (scans with no raw findings are absent)."""
    r = raw.groupBy("scan_id").agg(F.count(F.lit(1)).alias("raw_count"))
    a = calibrated.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("accepted_count"),
        F.count_if(F.col("is_critical")).alias("critical_count"),
        F.count_if(F.col("note").contains("Upgraded")).alias("upgraded_count"),
        F.count_if(F.col("note").contains("Downgraded")).alias("downgraded_count"),
    )
    j = r.join(a, "scan_id", "left")
    return j.select(
        "scan_id", F.col("raw_count").cast("bigint").alias("raw_count"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
          for c in ["accepted_count", "critical_count", "upgraded_count", "downgraded_count"]],
    ).withColumn("dropped_count", F.col("raw_count") - F.col("accepted_count"))
