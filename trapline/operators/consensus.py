"""A1–A11 — consensus gate, residual filters, dedupe and per-category cap.

Order semantics: a finding's position after the gate is the struct
``k5 = (element-group first position, -confidence, pos)``.  The three dedupe
passes keep the best-confidence member of each key (earliest on ties) at the
earliest position of the key.  Every step is a window keyed by scan_id
first, so after the single hash(scan_id) exchange no step shuffles again; a
scan is one captured page, so its findings are bounded by the page size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions import fixed
from trapline.functions.columns import (contains_any, count_contained, in_list, lookup,
                                        py_strip)


def page_context(scans: DataFrame, text_col: str = "page_text") -> DataFrame:
    """A2: booking / ecommerce / generic per scan from its page text."""
    t = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    ctx = (F.when(count_contained(t, fixed.BOOKING_CONTEXT_KEYWORDS) >= 2, "booking")
           .when(count_contained(t, fixed.ECOMMERCE_CONTEXT_KEYWORDS) >= 2, "ecommerce")
           .otherwise("generic"))
    return scans.select("scan_id", ctx.alias("context"))


def signal_strength(element_key: F.Column | None = None) -> F.Column:
    """A3: strong / moderate / weak (``element_key`` = lower(strip(element))
    when already computed)."""
    engine_l = F.lower(F.col("engine"))
    e = F.lower(py_strip(F.col("element"))) if element_key is None else element_key
    has_sel = ~in_list(e, fixed.GENERIC_ELEMENTS)
    structural = has_sel & contains_any(e, fixed.STRUCTURAL_ELEMENT_MARKERS)
    multi = F.lower(F.col("type")).contains("multi")
    visual = engine_l.contains("visual") & has_sel
    ml_only = engine_l.contains("ml")
    return (F.when(structural | multi | visual, "strong")
            .when(ml_only & ~has_sel, "weak")
            .when(has_sel | F.col("category").isin("preselection", "cookie", "tracking"), "moderate")
            .otherwise("weak"))


def gate(fused: DataFrame, scans: DataFrame) -> DataFrame:
    """A1–A5: confidence floor, signal strength, element grouping and the
    consensus rules.  Adds context, signal, gate_reason and k5."""
    # lower(strip(element)) once; reused by the signal, the group key, the
    # residual filter and the element dedupe
    cand = (fused.where(F.col("confidence") >= fixed.MIN_CONFIDENCE)
            .withColumn("_el", F.lower(py_strip(F.col("element")))))
    cand = (cand.withColumn("signal", signal_strength(F.col("_el")))
            .withColumn("ekey", F.coalesce(F.nullif(F.col("_el"), F.lit("")), F.lit("__no_selector__"))))
    # element-group and category engine counts as windows over the
    # scan_id-partitioned findings (count(distinct) over a window is written
    # as size(collect_set)).
    w_e = Window.partitionBy("scan_id", "ekey")
    w_c = Window.partitionBy("scan_id", "category")
    ctx = page_context(scans)
    # the category window first: it takes the order that calibration and fusion leave
    c = (_rules(cand.withColumn("n_cat", F.size(F.collect_set("engine").over(w_c))))
         .withColumn("n_src", F.size(F.collect_set("engine").over(w_e)))
         .withColumn("gpos", F.min("pos").over(w_e))
         .join(ctx, "scan_id", "left")
         .withColumn("context", F.coalesce(F.col("context"), F.lit("generic"))))

    shop = F.col("context").isin("booking", "ecommerce")
    eff = F.greatest(F.col("n_src"), F.col("n_cat"))
    reason = (
        F.when(F.col("_failsafe").isNotNull(), F.col("_failsafe"))
        .when(eff >= 2, F.concat(F.lit("Consensus: "), eff.cast("string"), F.lit(" engines")))
        .when(F.col("_signal") & shop, F.concat(F.initcap(F.col("signal")), F.lit(" signal in "), F.col("context"),
                                                F.lit(" context")))
        .when(shop & F.col("_pressure"),
              F.concat(F.lit("Context-aware single signal ("), F.col("category"), F.lit(" in "),
                       F.col("context"), F.lit(")")))
        .otherwise(F.col("_alone"))
    )
    return (c.withColumn("gate_reason", reason).where(F.col("gate_reason").isNotNull())
            .drop("_failsafe", "_signal", "_pressure", "_alone")
            .withColumn("k5", F.struct(F.col("gpos"), (-F.col("confidence")).alias("nc"), F.col("pos")))
            .drop("n_src", "n_cat", "gpos", "ekey"))


def _rules(cand: DataFrame) -> DataFrame:
    """A5, what a finding tells by itself: the reasons that come before the count of
    engines (``_failsafe``) and after it (``_alone``).  Added before a window, so that
    no generated method grows too large for the JVM to compile."""
    sev = F.col("severity")
    conf = F.col("confidence")
    sig_ok = F.col("signal").isin("strong", "moderate")
    type_l = F.lower(F.col("type"))
    cat_l = F.lower(F.col("category"))
    harm = contains_any(type_l, fixed.CRITICAL_FAILSAFE_TYPES) | contains_any(cat_l, fixed.CRITICAL_FAILSAFE_TYPES)
    engine_l = F.lower(F.col("engine"))
    grave = sev.isin("HIGH", "CRITICAL")
    failsafe = (
        F.when((sev == "CRITICAL") & (conf >= fixed.FAILSAFE_CONFIDENCE) & harm,
               F.lit("Failsafe: critical harm type"))
        .when(F.col("is_critical") & grave & (conf >= fixed.FAILSAFE_CONFIDENCE) & sig_ok,
              F.lit("Failsafe: critical finding with a strong structural signal"))
    )
    alone = (
        F.when(sig_ok & (sev == "CRITICAL"), F.lit("Single-engine CRITICAL with moderate+ signal"))
        .when((F.col("category") == fixed.COMPOUND_CATEGORY) & grave, F.lit("Compound pattern"))
        .when(in_list(engine_l, fixed.SPECIALIST_ENGINES) & in_list(F.col("category"), fixed.SPECIALIST_CATEGORIES)
              & grave & sig_ok & (conf >= 0.70),
              F.concat(F.lit("Specialist engine ("), engine_l, F.lit(") with strong evidence")))
    )
    return (cand.withColumn("_failsafe", failsafe).withColumn("_signal", sig_ok)
            .withColumn("_pressure", F.col("category").isin("urgency", "social_proof") & (conf >= 0.70))
            .withColumn("_alone", alone))


def residual_filter(gated: DataFrame) -> DataFrame:
    """Drop ml weak signals and INFORMATIONAL findings without a selector."""
    ml_weak = F.lower(F.col("engine")).contains("ml") & (F.col("signal") == "weak")
    info_nosel = (F.col("severity") == "INFORMATIONAL") & in_list(F.col("_el"), fixed.GENERIC_ELEMENTS)
    return gated.where(~(ml_weak | info_nosel))


def type_key() -> F.Column:
    """Findings of equal keys are of one type."""
    return F.lower(py_strip(F.col("type")))


def consensus_tag(kept: DataFrame) -> DataFrame:
    """Recount engines per (scan, category); tag or cap single-engine
    HIGH/CRITICAL findings at MEDIUM."""
    # in the order of the first dedupe pass, which then needs no sort of its own
    w = (Window.partitionBy("scan_id", "category").orderBy(F.col("_tkey"), F.col("confidence").desc(), F.col("k5").asc())
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    c = (kept.withColumn("_tkey", type_key())
         .withColumn("n_cat2", F.size(F.collect_set("engine").over(w))))
    protected = F.col("is_critical") | F.col("gate_reason").startswith("Failsafe")
    cap = (F.col("n_cat2") == 1) & F.col("severity").isin("HIGH", "CRITICAL") & ~protected
    return (c.withColumn("consensus",
                         F.when(F.col("n_cat2") >= 2,
                                F.concat(F.lit("Confirmed by "), F.col("n_cat2").cast("string"), F.lit(" engines")))
                         .when(cap, F.lit("Single-engine signal - severity capped at MEDIUM")))
            .withColumn("severity", F.when(cap, F.lit("MEDIUM")).otherwise(F.col("severity")))
            .withColumn("consensus_engine_count", F.col("n_cat2").cast("bigint"))
            .drop("n_cat2"))


def _keep_best(df: DataFrame, keys: list, pos_col: str, new_pos: str) -> DataFrame:
    """Keep per key the highest-confidence row (earliest ``pos_col`` on ties),
    placed at the key's earliest position ``new_pos``."""
    # one partition+order spec for both expressions -> one sort
    wo = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), F.col(pos_col).asc())
    whole = wo.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (df.withColumn(new_pos, F.min(pos_col).over(whole))
            .withColumn("_best", F.row_number().over(wo))
            .where(F.col("_best") == 1).drop("_best", pos_col))


def dedupe_and_cap(tagged: DataFrame, cap: int | None = fixed.MAX_PER_CATEGORY,
                   compound_cap: int | None = fixed.MAX_COMPOUND, evidence_chars: int | None = None) -> DataFrame:
    """A8–A11.  Adds rank_in_category and cat_first (category order key).
    A10 compares whole evidence texts (``evidence_chars``: only a prefix); a
    cap of None keeps every finding."""
    e = F.col("_el")
    generic = in_list(e, fixed.GENERIC_ELEMENTS)
    if "_tkey" not in tagged.columns:
        tagged = tagged.withColumn("_tkey", type_key())
    evidence = F.coalesce(F.col("evidence"), F.lit(""))
    if evidence_chars is not None:
        evidence = F.substring(evidence, 1, evidence_chars)
    d = (tagged.withColumn("_generic", generic)
         .withColumn("_ekey", F.when(F.col("_generic"), F.col("_tkey")).otherwise(e))
         .withColumn("_vkey", py_strip(F.lower(evidence))))
    d = _keep_best(d, ["scan_id", "category", "_tkey"], "k5", "k8")
    d = _keep_best(d, ["scan_id", "category", "_generic", "_ekey"], "k8", "k9")
    d = _keep_best(d, ["scan_id", "category", "_vkey"], "k9", "k10")
    sev_rank = lookup(F.col("severity"), fixed.SEVERITY_RANK, 1)
    w = Window.partitionBy("scan_id", "category").orderBy(sev_rank.desc(), F.col("confidence").desc(),
                                                         F.col("k10").asc())
    every = (1 << 31) - 1
    limit = F.when(F.col("category") == fixed.COMPOUND_CATEGORY, every if compound_cap is None else compound_cap).otherwise(
        every if cap is None else cap)
    # category order = earliest position of any member before the cap
    wc = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (d.withColumn("cat_first", F.min("k10").over(wc))
            .withColumn("rank_in_category", F.row_number().over(w))
            .where(F.col("rank_in_category") <= limit)
            .drop("_tkey", "_generic", "_ekey", "_vkey", "_el"))


def aggregate(fused: DataFrame, scans: DataFrame, cap: int | None = fixed.MAX_PER_CATEGORY,
              compound_cap: int | None = fixed.MAX_COMPOUND) -> DataFrame:
    """The validated findings of every scan."""
    return dedupe_and_cap(consensus_tag(residual_filter(gate(fused, scans))), cap, compound_cap)
