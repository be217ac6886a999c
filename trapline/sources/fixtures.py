"""Test overlays derived in-query from the driver tables.

The driver tables hold none of the detector vocabulary, so the findings
pipeline is exercised on *overlay A* (scans and findings derived from
orders / line items) and the detectors on *overlay B* (pages with planted
HTML snippets).  Nothing is written back; every overlay is a plain
DataFrame over the parquet scan, so its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapline.functions import fixed
from trapline.session import dealt_by_key, tasks_by_rows
from trapline.sources.tables import read_table

# Finding catalogue for overlay A:
# (cat_id, engine, type, category, severity, conf_pct, element)
CATALOGUE = [
    (0, "dom", "Pre-Selected Marketing Checkbox", "preselection", "HIGH", 92, 'input[type=checkbox][name="n"]'),
    (1, "dom", "Pre-Selected Subscription Enrolment", "forced_continuity", "HIGH", 90, 'input[type=checkbox][name="t"]'),
    (2, "dom", "Pre-Selected Upsell / Add-On", "preselection", "MEDIUM", 80, 'input[type=checkbox][name="u"]'),
    (3, "dom", "Countdown Timer / Fake Urgency", "urgency", "MEDIUM", 78, "div.countdown"),
    (4, "dom", "Potential Drip Pricing", "hidden_costs", "MEDIUM", 70, "Multiple price elements"),
    (5, "dom", "Basket Sneaking (Hidden Field)", "hidden_costs", "HIGH", 80, 'input[type=hidden][name="cart"]'),
    (6, "dom", "Confirmshaming Button", "confirmshaming", "HIGH", 88, "button#decline"),
    (7, "text", "Numeric Scarcity Claim", "urgency", "MEDIUM", 88, "span .badge"),
    (8, "text", "Standalone Urgency Claim", "urgency", "MEDIUM", 82, "p"),
    (9, "text", "Urgency/Scarcity Messaging", "urgency", "MEDIUM", 78, "div .banner"),
    (10, "visual", "Fine Print Legal Link", "visual_obstruction", "MEDIUM", 78, "a.fine-print"),
    (11, "visual", "Disguised Advertisement", "disguised_ads", "MEDIUM", 80, "div.native-ad"),
    (12, "visual", "Button Visual Misdirection", "visual_misdirection", "MEDIUM", 75, "Button pair (visual hierarchy)"),
    (13, "visual", "Urgency Color Saturation", "visual_urgency", "LOW", 68, "Multiple elements"),
    (14, "advanced", "Dark Download Funnel", "misdirection", "HIGH", 82, "a[href] (download link)"),
    (15, "advanced", "Meta-Refresh Auto-Redirect", "obstruction", "HIGH", 88, 'meta[http-equiv="refresh"]'),
    (16, "advanced", "Potential Software Bundling / PUA", "hidden_costs", "HIGH", 75, "a[href] + page text"),
    (17, "advanced", "Hidden Cancellation Path", "obstruction", "HIGH", 78, "Page-level (missing cancel link)"),
    (18, "advanced", "Buried Cancellation Link", "obstruction", "MEDIUM", 72, "footer a (cancel link)"),
    (19, "advanced", "Phone-Gate Cancellation", "obstruction", "HIGH", 82, "Page text (cancellation policy)"),
    (20, "advanced", "Pricing Hidden Behind JS Gate", "hidden_costs", "MEDIUM", 68, "JS-gated container (modal/accordion)"),
    (21, "advanced", "Subscription Upsell on Product Page", "forced_continuity", "HIGH", 78, "Product / checkout page (subscription offer)"),
    (22, "cookie", "COOKIE_MANIPULATION", "cookie_wall", "CRITICAL", 82, "Cookie Banner / Consent Dialog"),
    (23, "cookie", "COOKIE_MANIPULATION", "privacy", "MEDIUM", 82, "Cookie Banner / Consent Dialog"),
    (24, "cookie", "Tracking Before Consent", "privacy", "HIGH", 85, "script (tracking)"),
    (25, "link", "Dark Download Funnel", "misdirection", "HIGH", 85, "Download Link"),
    (26, "link", "Roach Motel — No Exit Path", "obstruction", "HIGH", 80, "Page-level (missing exit/cancel link)"),
    (27, "readability", "Deliberately Complex Legal Language", "obstruction", "HIGH", 82, "Page text (readability analysis)"),
    (28, "readability", "Above-Average Reading Complexity", "obstruction", "MEDIUM", 70, "Page text (readability analysis)"),
    (29, "readability", "High Legal Jargon Density", "obstruction", "MEDIUM", 75, "Page text (jargon density analysis)"),
    (30, "readability", "Forced Arbitration / Class Action Waiver", "obstruction", "HIGH", 88, "Page text (arbitration detection)"),
    (31, "readability", "Early Cancellation / Exit Fee", "forced_continuity", "HIGH", 88, "Page text (cancellation terms)"),
    (32, "ml", "ML: Urgency", "urgency", "MEDIUM", 81, "Page text (ML statistical prediction)"),
    (33, "ml", "ML: Privacy Manipulation", "privacy", "HIGH", 84, "Page text (ML statistical prediction)"),
    (34, "ml", "ML: Social Proof", "social_proof", "LOW", 83, "span .proof"),
    (35, "ml", "ML: Basket Sneaking", "basket_sneaking", "HIGH", 74, "Page text (ML statistical prediction)"),
    (36, "behavioral", "Dynamic Manipulation", "misdirection", "HIGH", 80, "Whole page (post-interaction DOM diff)"),
    (37, "behavioral", "Scan Incomplete", "informational", "INFORMATIONAL", 95, "document body"),
    (38, "custom", "Custom Critical Probe", "misdirection", "CRITICAL", 90, "div.custom"),
]
CRITICAL_AT_EMISSION = (22, 24)
DYNAMIC_IDS = (36, 37)
N_CATALOGUE = len(CATALOGUE)

PAGE_TEXT_BY_PRIORITY = {
    "1-URGENT": "hotel room per night",
    "2-HIGH": "checkout cart shipping",
}
PLAIN_PAGE_TEXT = "plain page"


def catalogue_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CATALOGUE,
        "cat_id long, engine string, type string, category string, severity string, "
        "conf_pct int, element string",
    )


def _engine_rank(cat_id, engine):
    rank = F.coalesce(
        F.try_element_at(F.create_map(*[x for i, e in enumerate(fixed.ENGINE_ORDER)
                                    for x in (F.lit(e), F.lit(i))]), engine),
        F.lit(fixed.CUSTOM_ENGINE_RANK))
    return F.when(cat_id.isin(*DYNAMIC_IDS), F.lit(fixed.DYNAMIC_RANK)).otherwise(rank)


def overlay_scans(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Scans: one per order (clean orders without line items included)."""
    o = read_table(spark, sf_dir, "orders")
    page_text = (F.when(F.col("o_orderpriority") == "1-URGENT", PAGE_TEXT_BY_PRIORITY["1-URGENT"])
                 .when(F.col("o_orderpriority") == "2-HIGH", PAGE_TEXT_BY_PRIORITY["2-HIGH"])
                 .otherwise(PLAIN_PAGE_TEXT))
    if coarse:
        # coarse variant: 1000 scans, context chosen from the scan id
        sid = (F.col("o_orderkey") % 1000)
        return (o.select(sid.alias("scan_id")).distinct()
                .select("scan_id",
                        F.concat(F.lit("site-"), (F.col("scan_id") % 97).cast("string")).alias("domain"),
                        F.when(F.col("scan_id") % 3 == 0, PAGE_TEXT_BY_PRIORITY["1-URGENT"])
                        .when(F.col("scan_id") % 3 == 1, PAGE_TEXT_BY_PRIORITY["2-HIGH"])
                        .otherwise(PLAIN_PAGE_TEXT).alias("page_text"),
                        F.lit("unknown").alias("scan_state")))
    return o.select(
        F.col("o_orderkey").alias("scan_id"),
        F.concat(F.lit("site-"), F.col("o_custkey").cast("string")).alias("domain"),
        F.concat(F.lit("https://site-"), F.col("o_custkey").cast("string"),
                 F.lit(".example/p/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_orderdate").alias("scan_ts"),
        (F.lit(5) + F.floor("o_totalprice").cast("bigint") % 91).alias("raw_score"),
        F.when(F.col("o_orderstatus") == "P", "unauthenticated")
        .when(F.col("o_orderstatus") == "F", "authenticated")
        .otherwise("unknown").alias("scan_state"),
        page_text.alias("page_text"),
    )


def finding_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions that share the overlay's findings; None: left to AQE."""
    return tasks_by_rows(read_table(spark, sf_dir, "lineitem"))


def overlay_findings(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Raw findings: one per line item, typed through the catalogue.

    Columns: scan_id, erank, seq, pos, engine, type, category, severity,
    confidence, element, evidence, description, recommendation, legal_refs,
    is_critical.
    """
    li = read_table(spark, sf_dir, "lineitem")
    all_cols = [c for c in li.columns]
    if coarse:
        li = li.withColumn("scan_id", F.col("l_orderkey") % 1000)
        w = Window.partitionBy("scan_id").orderBy(*all_cols)
    else:
        li = li.withColumn("scan_id", F.col("l_orderkey"))
        w = Window.partitionBy("scan_id").orderBy(*all_cols[1:])
    # a task's sorts do not grow with the table, nor does one task get many scans
    li = dealt_by_key(li, "scan_id")
    li = li.withColumn("seq", F.row_number().over(w).cast("bigint"))
    li = li.withColumn("cat_id", (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % N_CATALOGUE)
    # the catalogue is a fixed 39-row literal table: broadcasting it is bounded
    j = li.join(F.broadcast(catalogue_df(spark)), "cat_id")
    conf = (F.least(F.lit(99), F.col("conf_pct") + ((F.col("l_partkey") + F.col("l_linenumber")) % 7 - 3) * 5)
            / F.lit(100.0)).cast("double")
    element = F.when(F.col("l_suppkey") % 5 == 0,
                     F.concat(F.lit("div.offer-"), (F.col("l_partkey") % 3).cast("string"))
                     ).otherwise(F.col("element"))
    erank = _engine_rank(F.col("cat_id"), F.col("engine"))
    return j.select(
        "scan_id",
        erank.alias("erank"),
        "seq",
        (erank.cast("bigint") * F.lit(1 << 40) + F.col("seq")).alias("pos"),
        "engine", "type", "category", "severity",
        conf.alias("confidence"),
        element.alias("element"),
        F.concat(F.lit("evidence "), (F.col("l_partkey") % 50).cast("string")).alias("evidence"),
        F.concat(F.col("type"), F.lit(" detected")).alias("description"),
        F.concat(F.lit("Remove the "), F.col("category"), F.lit(" pattern")).alias("recommendation"),
        F.array().cast("array<string>").alias("legal_refs"),
        F.col("cat_id").isin(*CRITICAL_AT_EMISSION).alias("is_critical"),
    )
