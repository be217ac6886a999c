"""N1–N7 — analytics over the stored report table.

All operators are declarative: top-k and paging are ``row_number`` filters
(partial WindowGroupLimit before the shuffle), statistics are single
aggregates, and the expectation / ground-truth tables are tiny literal
dimension tables joined by broadcast (their size is fixed by the caller).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions.columns import exact_avg, round_half_up
from trapline.session import materialize


def _recent(store: DataFrame, ts: str = "timestamp") -> Window:
    return Window.orderBy(F.col(ts).desc(), F.col("scan_id").desc())


NEAR_ROWS = 10_000


def paged_history(store: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    """Newest first (ties: higher scan_id first), 1-based page of ``limit`` rows
    (any number from 1; less is refused).  The first NEAR_ROWS rows are a bounded
    sort; a page beyond them is found by dealing the rows by range, counting each
    range, and numbering only the ranges that the page lies in."""
    if limit < 1 or page < 1:
        raise ValueError("page and limit start at 1")
    offset = (page - 1) * limit
    cols = ["scan_id", "url", "domain", "trust_score", "grade", "total_patterns", "risk_label", "timestamp"]
    order = [F.col("timestamp").desc(), F.col("scan_id").desc()]
    if offset + limit <= NEAR_ROWS:
        top = store.select(*cols).orderBy(*order).limit(offset + limit)
        return (top.withColumn("position", F.row_number().over(_recent(top)).cast("bigint"))
                .where(F.col("position") > offset))
    n = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(store.select(*cols).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "history-ranges")
    before, skip = 0, F.lit(None).cast("bigint")
    for r in sorted(dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_range"]):  # one row a range
        if before < offset + limit and before + r["n"] > offset:
            skip = F.when(F.col("_range") == r["_range"], F.lit(before)).otherwise(skip)
        before += r["n"]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_skip")
    return (dealt.withColumn("_skip", skip).where("_skip is not null").withColumn("position", place.cast("bigint"))
            .where((F.col("position") > offset) & (F.col("position") <= offset + limit)).select(*cols, "position"))


def top_categories(store: DataFrame, findings: DataFrame, recent: int = 50, k: int = 5) -> DataFrame:
    """Top-k categories among the findings of the ``recent`` newest
    scans (count desc, then category)."""
    last = store.select("scan_id", "timestamp").orderBy(F.col("timestamp").desc(), F.col("scan_id").desc()) \
        .limit(recent).select("scan_id")
    counts = (findings.where(F.coalesce(F.col("category"), F.lit("")) != "")
              .join(last, "scan_id", "left_semi")
              .groupBy("category").agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    w = Window.orderBy(F.col("n").desc(), F.col("category").asc())
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def global_stats(store: DataFrame) -> DataFrame:
    """One row; zeros on an empty table."""
    label = F.col("risk_label")
    return store.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_scans"),
        F.coalesce(round_half_up(exact_avg(F.col("trust_score").cast("double")), 1), F.lit(0.0)).alias("avg_trust_score"),
        F.count_if(label.like("%High%") | label.like("%Critical%")).cast("bigint").alias("high_risk_count"),
        F.coalesce(F.min("trust_score"), F.lit(0)).cast("bigint").alias("min_trust_score"),
        F.coalesce(F.max("trust_score"), F.lit(0)).cast("bigint").alias("max_trust_score"),
        F.coalesce(round_half_up(exact_avg(F.col("total_patterns").cast("double")), 1), F.lit(0.0)).alias("avg_patterns"),
    )


def dashboard(store: DataFrame, recent: int = 50, listed: int = 20) -> DataFrame:
    """Global stats plus the risk-label mode / distribution over the
    newest ``recent`` scans (mode ties broken by first appearance, newest
    first) and the ids of the newest ``listed`` scans."""
    last = (store.select("scan_id", "timestamp", "risk_label")
            .orderBy(F.col("timestamp").desc(), F.col("scan_id").desc()).limit(recent))
    last = last.withColumn("pos", F.row_number().over(_recent(last)))
    dist = last.groupBy("risk_label").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    summary = dist.agg(
        F.max_by("risk_label", F.struct(F.col("n"), (-F.col("first")).alias("f"))).alias("most_common_risk"),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.col("risk_label"), F.lit(":"), F.col("n").cast("string")))),
                     ",").alias("risk_distribution"))
    listed_ids = last.where(F.col("pos") <= listed).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "scan_id"))),
                                 lambda s: s["scan_id"].cast("string")), ",").alias("recent_scan_ids"))
    g = global_stats(store).select("total_scans", "avg_trust_score", F.col("max_trust_score").alias("highest_trust"),
                                  F.col("min_trust_score").alias("lowest_trust"))
    return g.crossJoin(summary).crossJoin(listed_ids)


def expectation_check(store: DataFrame, bands: DataFrame, type_col: str = "site_type") -> DataFrame:
    """Score and pattern count against the band of the scan's site type.
    ``bands`` is a small literal table (one row per site type); it is
    broadcast."""
    j = store.join(bands, type_col)
    s, p = F.col("trust_score"), F.col("total_patterns")
    score_issue = (F.when(s < F.col("min_score"), F.concat(F.lit("Score "), s.cast("string"),
                                                            F.lit(" below expected min "), F.col("min_score").cast("string"),
                                                            F.lit(" (possible FALSE POSITIVES)")))
                   .when(s > F.col("max_score"), F.concat(F.lit("Score "), s.cast("string"),
                                                           F.lit(" above expected max "), F.col("max_score").cast("string"),
                                                           F.lit(" (possible FALSE NEGATIVES)"))))
    pat_issue = (F.when(p < F.col("min_patterns"), F.concat(F.lit("Only "), p.cast("string"),
                                                            F.lit(" patterns found, expected ≥"),
                                                            F.col("min_patterns").cast("string"), F.lit(" (FALSE NEGATIVE risk)")))
                 .when(p > F.col("max_patterns"), F.concat(p.cast("string"), F.lit(" patterns found, expected ≤"),
                                                           F.col("max_patterns").cast("string"),
                                                           F.lit(" (FALSE POSITIVE risk)"))))
    notes = F.concat_ws("; ", score_issue, pat_issue)
    return j.select("scan_id", type_col, "trust_score", "total_patterns",
                    F.when(notes == "", "PASS").otherwise("WARN").alias("verdict"), notes.alias("notes"))


def rule_check(store: DataFrame, findings: DataFrame, truth: DataFrame, type_col: str = "site_type") -> DataFrame:
    """Per scan, issue counts against the ground truth of its site type
    (score band, finding-count band, required / forbidden categories,
    CRITICAL findings on clean sites, confidence below 0.50).  Required /
    forbidden categories are tested with semi / anti joins over the
    exploded truth lists."""
    st = store.join(truth, type_col)
    req = (st.select("scan_id", F.explode("must_have").alias("category"))
           .join(findings.select("scan_id", "category").distinct(), ["scan_id", "category"], "left_anti")
           .groupBy("scan_id").agg(F.count(F.lit(1)).alias("missing_required")))
    forb = (st.select("scan_id", F.explode("must_not_have").alias("category"))
            .join(findings.select("scan_id", "category"), ["scan_id", "category"])
            .groupBy("scan_id").agg(F.count(F.lit(1)).alias("forbidden_found")))
    fstats = (findings.join(st.select("scan_id", "clean"), "scan_id")
              .groupBy("scan_id").agg(
                  F.count_if(F.col("clean") & (F.col("severity") == "CRITICAL")).alias("critical_on_clean"),
                  F.count_if(F.col("confidence") < 0.50).alias("low_confidence")))
    j = st.join(req, "scan_id", "left").join(forb, "scan_id", "left").join(fstats, "scan_id", "left")
    zero = F.lit(0).cast("bigint")
    j = j.select("scan_id", type_col, "trust_score", "total_patterns",
                 F.when((F.col("trust_score") < F.col("min_score")) | (F.col("trust_score") > F.col("max_score")), 1)
                 .otherwise(0).cast("bigint").alias("score_issue"),
                 F.when((F.col("total_patterns") > F.col("max_patterns")) | (F.col("total_patterns") < F.col("min_patterns")), 1)
                 .otherwise(0).cast("bigint").alias("count_issue"),
                 *[F.coalesce(F.col(c), zero).cast("bigint").alias(c)
                   for c in ["missing_required", "forbidden_found", "critical_on_clean", "low_confidence"]])
    total = (F.col("score_issue") + F.col("count_issue") + F.col("missing_required") + F.col("forbidden_found")
             + F.col("critical_on_clean") + F.col("low_confidence"))
    return j.withColumn("issues", total).withColumn("passed", total == 0)


def site_type_summary(checked: DataFrame, type_col: str = "site_type") -> DataFrame:
    """Per site type PASS / WARN / ERROR counts and average score."""
    v = F.col("verdict")
    return checked.groupBy(type_col).agg(
        F.count_if(v == "PASS").cast("bigint").alias("pass_count"),
        F.count_if(v.isin("WARN", "FAIL")).cast("bigint").alias("warn_count"),
        F.count_if(~v.isin("PASS", "WARN", "FAIL")).cast("bigint").alias("error_count"),
        F.coalesce(round_half_up(exact_avg(F.col("trust_score").cast("double")), 1), F.lit(0.0)).alias("avg_score"),
    )
