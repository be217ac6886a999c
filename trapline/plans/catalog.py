"""Registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir) and reads the whole driver tables (or
DataFrames Spark derives from them); nothing runs on fixed small input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions import fixed
from trapline.operators import calibrate as H
from trapline.operators import consensus as A
from trapline.operators import fuse as Fu
from trapline.operators import report as R
from trapline.operators import risk as K
from trapline.operators import temporal as T
from trapline.operators.compound import compound_findings, with_compound
from trapline.plans import full_scan as P
from trapline.plans import oracle_sql as O
from trapline.session import ensure_parallelism
from trapline.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _raw(spark, sf_dir, coarse=False):
    return fx.overlay_findings(spark, sf_dir, coarse).repartition("scan_id")


def _run(spark, sf_dir, coarse=False) -> P.ScanRun:
    """The run over the overlay, for queries that read one of its tables; the overlay's
    findings come hashed on scan_id."""
    return P.run_findings(fx.overlay_scans(spark, sf_dir, coarse), fx.overlay_findings(spark, sf_dir, coarse),
                          partitions=fx.finding_tasks(spark, sf_dir), materialize_stages=False, hashed=True)


def _with_pipeline(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


PIPE = [O.overlay_a(), O.compound_ctes(), O.calibrate_ctes(), O.fuse_ctes(), O.consensus_ctes()]
PIPE_COARSE = [O.overlay_a(coarse=True), O.compound_ctes(), O.calibrate_ctes(), O.fuse_ctes(), O.consensus_ctes()]

# ---------------------------------------------------------------- D36 ------
register("compound_patterns", _with_pipeline(O.overlay_a(), O.compound_ctes()) + """
SELECT scan_id, severity, confidence, evidence, description FROM cmp""")(
    lambda spark, sf: compound_findings(_raw(spark, sf)).select(
        "scan_id", "severity", "confidence", "evidence", "description"))

# ---------------------------------------------------------------- H --------
CAL_COLS = ["scan_id", "seq", "engine", "type", "category", "severity", "raw_severity", "impact", "intent",
            "note", "is_critical"]


@register("findings_calibrated", _with_pipeline(*PIPE[:3]) + f"""
SELECT {", ".join(CAL_COLS)} FROM cal""")
def q_calibrated(spark, sf):
    return H.calibrate(with_compound(_raw(spark, sf))).select(*CAL_COLS)


@register("calibration_stats", _with_pipeline(*PIPE[:3]) + """,
r AS (SELECT scan_id, CAST(count(*) AS BIGINT) AS raw_count FROM all_pre GROUP BY scan_id),
a AS (SELECT scan_id, count(*) AS accepted_count, count_if(is_critical) AS critical_count,
             count_if(contains(note, 'Upgraded')) AS upgraded_count,
             count_if(contains(note, 'Downgraded')) AS downgraded_count FROM cal GROUP BY scan_id)
SELECT r.scan_id, raw_count,
       CAST(coalesce(accepted_count, 0) AS BIGINT) AS accepted_count,
       CAST(coalesce(critical_count, 0) AS BIGINT) AS critical_count,
       CAST(coalesce(upgraded_count, 0) AS BIGINT) AS upgraded_count,
       CAST(coalesce(downgraded_count, 0) AS BIGINT) AS downgraded_count,
       raw_count - CAST(coalesce(accepted_count, 0) AS BIGINT) AS dropped_count
FROM r LEFT JOIN a USING (scan_id)""")
def q_calibration_stats(spark, sf):
    raw = with_compound(_raw(spark, sf))
    return H.calibration_stats(raw, H.calibrate(raw))


# ---------------------------------------------------------------- F --------
FUSE_COLS = ["scan_id", "seq", "engine", "type", "category", "engine_count", "conf_boost", "fusion_confidence",
             "fusion_score"]


@register("fusion_findings", _with_pipeline(*PIPE[:4]) + f"""
SELECT {", ".join(FUSE_COLS)} FROM fused""")
def q_fusion(spark, sf):
    return Fu.fuse(H.calibrate(with_compound(_raw(spark, sf)))).select(*FUSE_COLS)


@register("fusion_category", _with_pipeline(*PIPE[:3]) + f""",
e AS (SELECT scan_id, category, engine,
             max(confidence * {O.case_map('engine', fixed.FUSION_WEIGHTS, fixed.FUSION_DEFAULT_WEIGHT)}) AS weighted
      FROM cal GROUP BY scan_id, category, engine)
SELECT scan_id, category, {O.rnd(f"least(1.0, {O.exact_sum("weighted")} / {O.dbl(sum(fixed.FUSION_WEIGHTS.values()))})", 3)} AS category_score,
       CAST(count(*) AS BIGINT) AS engine_count, string_agg(engine, ',' ORDER BY engine) AS engines
FROM e GROUP BY scan_id, category""")
def q_fusion_category(spark, sf):
    cf = Fu.category_fusion(H.calibrate(with_compound(_raw(spark, sf))))
    return cf.select("scan_id", "category", R_round3("category_score").alias("category_score"), "engine_count",
                     F.array_join("fusion_engines", ",").alias("engines"))


def R_round3(c):
    from trapline.functions.columns import round_half_up
    return round_half_up(F.col(c), 3)


@register("fusion_scan_score", _with_pipeline(*PIPE[:4]) + f"""
SELECT s.scan_id, CASE WHEN count(f.scan_id) = 0 THEN 0.0 ELSE
       {O.rnd(f"least(1.0, {O.exact_avg('fusion_score')} * 0.6 + least(avg(engine_count) / 4.0, 1.0) * 0.4)", 3)} END
       AS fusion_scan_score
FROM scans_a2 s LEFT JOIN fused f USING (scan_id) GROUP BY s.scan_id""")
def q_fusion_scan(spark, sf):
    fused = Fu.fuse(H.calibrate(with_compound(_raw(spark, sf))))
    return Fu.scan_fusion_score(fused, fx.overlay_scans(spark, sf))


# ---------------------------------------------------------------- A --------
CONS_COLS = ["scan_id", "seq", "engine", "type", "category", "severity", "confidence", "signal", "context",
             "gate_reason", "consensus", "rank_in_category"]


def _cons_select():
    return f"SELECT {', '.join(CONS_COLS[:-1])}, CAST(rank_in_category AS BIGINT) AS rank_in_category FROM validated"


@register("consensus_findings", _with_pipeline(*PIPE) + "\n" + _cons_select())
def q_consensus(spark, sf):
    v = _run(spark, sf).validated
    return v.select(*CONS_COLS[:-1], F.col("rank_in_category").cast("bigint").alias("rank_in_category"))


@register("consensus_dedupe_cap", _with_pipeline(*PIPE_COARSE) + "\n" + _cons_select())
def q_consensus_coarse(spark, sf):
    v = _run(spark, sf, coarse=True).validated
    return v.select(*CONS_COLS[:-1], F.col("rank_in_category").cast("bigint").alias("rank_in_category"))


# ---------------------------------------------------------------- R --------
@register("report_findings", _with_pipeline(*PIPE, O.report_ctes()) + f"""
SELECT rep.scan_id, 'dp-' || CAST(report_pos AS VARCHAR) AS finding_id, type, rep.category, severity, confidence,
       coalesce(ci.name, {O.title_case("replace(rep.category, '_', ' ')")}) AS category_name,
       coalesce(ci.description, {O.q(fixed.DEFAULT_CATEGORY_DESCRIPTION)}) AS category_description,
       coalesce((SELECT string_agg(DISTINCT x, '; ' ORDER BY x)
                 FROM (SELECT unnest(list_concat(rep.legal_refs, coalesce(l.refs, []))) AS x)), '') AS legal_refs
FROM rep LEFT JOIN catinfo ci ON ci.category = rep.category
     LEFT JOIN (SELECT category, list(ref) AS refs FROM legal GROUP BY category) l ON l.category = rep.category""")
def q_report_findings(spark, sf):
    run = _run(spark, sf)
    rep = R.report_findings(run.validated)
    return rep.select("scan_id", "finding_id", "type", "category", "severity", "confidence", "category_name", "category_description",
                      F.array_join("merged_refs", "; ").alias("legal_refs"))


REPORT_COLS = ["scan_id", "domain", "scan_state", "total_patterns", "n_critical", "n_high", "n_medium", "n_low",
               "n_informational", "n_scored_categories", "category_breakdown", "regulations_violated",
               "top_recommendations", "dom_findings", "text_findings", "visual_findings", "elite_findings",
               "trust_score", "grade", "risk_level", "risk_label", "compliance_flags", "summary"]


@register("scan_reports", _with_pipeline(*PIPE, O.report_ctes()) + f"""
SELECT {", ".join(REPORT_COLS)} FROM reports""")
def q_scan_reports(spark, sf):
    run = _run(spark, sf)
    return run.reports.select(*REPORT_COLS)


# ---------------------------------------------------------------- K --------
RISK_COLS = ["scan_id", "risk_score", "risk_level", "risk_label", "finding_count", "compound_bonus",
             "severity_distribution", "category_distribution"]


@register("risk_assessment", _with_pipeline(*PIPE, O.risk_ctes()) + """
SELECT s.scan_id, coalesce(risk_score, 0.0) AS risk_score, coalesce(risk_level, 'LOW') AS risk_level,
       coalesce(risk_label, 'Low Risk') AS risk_label, coalesce(finding_count, 0) AS finding_count,
       coalesce(compound_bonus, 1.0) AS compound_bonus,
       coalesce(severity_distribution, '') AS severity_distribution,
       coalesce(category_distribution, '') AS category_distribution
FROM scans_a2 s LEFT JOIN risk USING (scan_id)""")
def q_risk(spark, sf):
    scans = fx.overlay_scans(spark, sf)
    return K.risk_assessment(_run(spark, sf).validated, scans).select(*RISK_COLS)


# ---------------------------------------------------------------- T2 -------
@register("trust_smoothing", _with_pipeline(O.overlay_a(), O.smoothing_ctes("scans_a2", score="raw_score")) + """
SELECT s.scan_id, s.domain, CAST(s.raw_score AS BIGINT) AS raw_score, sm.smoothed_score, sm.history_depth
FROM scans_a2 s JOIN sm USING (scan_id)""")
def q_smoothing(spark, sf):
    scans = fx.overlay_scans(spark, sf)
    sm = T.smooth_trust(scans.select("scan_id", "domain", "scan_ts", "raw_score"), score="raw_score")
    return sm.select("scan_id", "domain", F.col("raw_score").cast("bigint").alias("raw_score"),
                     "smoothed_score", "history_depth")


# ---------------------------------------------------------------- P1 -------
FULL_COLS = REPORT_COLS[:-6] + ["trust_score_raw", "trust_score", "grade", "risk_level", "risk_label",
                                "compliance_flags", "summary", "history_depth", "risk_score",
                                "assessed_risk_level", "compound_bonus", "fusion_scan_score", "raw_findings",
                                "behavioral_findings", "after_calibration", "after_aggregation", "critical_boosted",
                                "calibration_upgraded", "calibration_downgraded", "dropped_by_calibration", "dropped_by_filter"]


def full_scan_oracle() -> str:
    fscore = O.rnd(f"least(1.0, {O.exact_avg('fusion_score')} * 0.6 + least(avg(engine_count) / 4.0, 1.0) * 0.4)", 3)
    body = _with_pipeline(*PIPE, O.report_ctes(), O.risk_ctes()) + f""",
fun_raw AS (SELECT scan_id, CAST(count(*) AS BIGINT) AS raw_findings,
                   CAST(count_if(erank = {fixed.COMPOUND_RANK}) AS BIGINT) AS behavioral_findings
            FROM all_pre GROUP BY scan_id),
fun_cal AS (SELECT scan_id, CAST(count(*) AS BIGINT) AS after_calibration,
                   CAST(count_if(is_critical) AS BIGINT) AS critical_boosted,
                   CAST(count_if(contains(note, 'Upgraded')) AS BIGINT) AS calibration_upgraded,
                   CAST(count_if(contains(note, 'Downgraded')) AS BIGINT) AS calibration_downgraded,
                   {fscore} AS fusion_scan_score
            FROM fused GROUP BY scan_id),
fun_val AS (SELECT scan_id, CAST(count(*) AS BIGINT) AS after_aggregation FROM validated GROUP BY scan_id),
pre AS (
  SELECT r.*, s.scan_ts, coalesce(k.risk_score, 0.0) AS risk_score, coalesce(k.risk_level, 'LOW') AS assessed_risk_level,
         coalesce(k.compound_bonus, 1.0) AS compound_bonus, coalesce(fc.fusion_scan_score, 0.0) AS fusion_scan_score,
         coalesce(fr.raw_findings, 0) AS raw_findings, coalesce(fr.behavioral_findings, 0) AS behavioral_findings,
         coalesce(fc.after_calibration, 0) AS after_calibration, coalesce(fv.after_aggregation, 0) AS after_aggregation,
         coalesce(fc.critical_boosted, 0) AS critical_boosted, coalesce(fc.calibration_upgraded, 0) AS calibration_upgraded,
         coalesce(fc.calibration_downgraded, 0) AS calibration_downgraded
  FROM reports r JOIN scans_a2 s USING (scan_id) LEFT JOIN risk k USING (scan_id) LEFT JOIN fun_raw fr USING (scan_id)
       LEFT JOIN fun_cal fc USING (scan_id) LEFT JOIN fun_val fv USING (scan_id)),
{O.smoothing_ctes("pre", score="trust_score")}
SELECT p.* EXCLUDE (trust_score, grade, risk_level, risk_label, scan_ts),
       p.trust_score AS trust_score_raw, sm.smoothed_score AS trust_score,
       {O.grade_sql('sm.smoothed_score')} AS grade, {O.risk_level_sql('sm.smoothed_score')} AS risk_level,
       {O.risk_label_sql('sm.smoothed_score')} AS risk_label, sm.history_depth,
       p.raw_findings - p.after_calibration AS dropped_by_calibration, p.after_calibration - p.after_aggregation AS dropped_by_filter
FROM pre p JOIN sm USING (scan_id)"""
    return f"SELECT {', '.join(FULL_COLS)} FROM ({body})"


@register("full_scan", full_scan_oracle())
def q_full_scan(spark, sf):
    scans = fx.overlay_scans(spark, sf)
    return P.full_scan(scans, fx.overlay_findings(spark, sf), fx.finding_tasks(spark, sf), hashed=True).select(*FULL_COLS)


# ======================================================= temporal T3–T7 =====
def _smoothed_raw(spark, sf):
    scans = fx.overlay_scans(spark, sf)
    return T.smooth_trust(scans.select("scan_id", "domain", "scan_ts", "raw_score"), score="raw_score")


SMOOTH_RAW = [O.overlay_a(), O.smoothing_ctes("scans_a2", score="raw_score")]


@register("temporal_trend", _with_pipeline(*SMOOTH_RAW) + f""",
t AS (SELECT s.scan_id, s.domain, s.scan_ts, sm.smoothed_score FROM scans_a2 s JOIN sm USING (scan_id)),
w AS (SELECT *, count(*) OVER w5 AS c, lag(smoothed_score) OVER wo AS prev, avg(smoothed_score) OVER w5 AS a
      FROM t WINDOW w5 AS (PARTITION BY domain ORDER BY scan_ts, scan_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
                    wo AS (PARTITION BY domain ORDER BY scan_ts, scan_id))
SELECT scan_id, domain, smoothed_score, c >= 2 AS has_trend, CAST(c AS BIGINT) AS trend_scan_count,
       CAST(CASE WHEN c >= 2 THEN prev ELSE 0 END AS BIGINT) AS previous_score,
       CASE WHEN c >= 2 THEN {O.rnd('a', 1)} ELSE 0.0 END AS average_score,
       CASE WHEN c >= 2 THEN (CASE WHEN smoothed_score > prev THEN 'improving' WHEN smoothed_score < prev THEN 'declining'
                                   ELSE 'stable' END) ELSE 'none' END AS trend,
       CAST(CASE WHEN c >= 2 THEN smoothed_score - prev ELSE 0 END AS BIGINT) AS delta
FROM w""")
def q_trend(spark, sf):
    tr = T.trend(_smoothed_raw(spark, sf))
    return tr.select("scan_id", "domain", "smoothed_score", "has_trend", "trend_scan_count", "previous_score",
                     "average_score", "trend", "delta")


@register("history_summary", _with_pipeline(*SMOOTH_RAW) + f""",
t AS (SELECT s.scan_id, s.domain, s.scan_ts, sm.smoothed_score,
             row_number() OVER (PARTITION BY s.domain ORDER BY s.scan_ts DESC, s.scan_id DESC) AS r
      FROM scans_a2 s JOIN sm USING (scan_id))
SELECT domain, CAST(count(*) AS BIGINT) AS scans, max(CASE WHEN r = 1 THEN smoothed_score END) AS latest_score,
       min(smoothed_score) AS min_score, max(smoothed_score) AS max_score, {O.rnd('avg(smoothed_score)', 1)} AS avg_score
FROM t WHERE r <= 5 GROUP BY domain""")
def q_history_summary(spark, sf):
    return T.history_summary(_smoothed_raw(spark, sf))


@register("persistent_findings", _with_pipeline(O.overlay_a()) + """,
sq AS (SELECT scan_id, domain, row_number() OVER (PARTITION BY domain ORDER BY scan_ts, scan_id) AS scan_seq FROM scans_a2),
ft AS (SELECT DISTINCT scan_id, type FROM raw_f),
c AS (SELECT ft.scan_id, ft.type, sq.scan_seq,
             count(*) OVER (PARTITION BY sq.domain, ft.type ORDER BY sq.scan_seq RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n
      FROM ft JOIN sq USING (scan_id))
SELECT scan_id, type, CAST(least(scan_seq - 1, 5) AS BIGINT) AS history_depth, CAST(n AS BIGINT) AS type_history_count,
       (least(scan_seq - 1, 5) < 2 OR n >= 2) AS persistent
FROM c""")
def q_persistent(spark, sf):
    f = fx.overlay_findings(spark, sf).select("scan_id", "type").distinct()
    out = T.persistent_split(f, fx.overlay_scans(spark, sf))
    return out.select("scan_id", "type", "history_depth", "type_history_count", "persistent")


def _timings(spark, sf):
    from trapline.sources.tables import read_table
    ev = read_table(spark, sf, "events")
    return ev.select(F.col("event_type").alias("name"), F.col("value").alias("ms"), "ts", "event_id",
                     (F.col("event_type") == "error").alias("is_error"))


@register("rolling_metrics", f"""
SELECT name, CAST(count(*) AS BIGINT) AS count, {O.rnd(O.exact_avg('ms'), 2)} AS avg_ms, {O.rnd('min(ms)', 2)} AS min_ms,
       {O.rnd('max(ms)', 2)} AS max_ms, {O.rnd('max(CASE WHEN r = 1 THEN ms END)', 2)} AS last_ms
FROM (SELECT event_type AS name, value AS ms,
             row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r <= 100 GROUP BY name""")
def q_rolling(spark, sf):
    return T.rolling_metrics(_timings(spark, sf))


@register("metric_totals", f"""
SELECT event_type AS name, CAST(count(*) AS BIGINT) AS calls, CAST(count_if(event_type = 'error') AS BIGINT) AS errors,
       {O.rnd(O.exact_sum('value'), 2)} AS total_ms, {O.rnd('arg_max(value, (ts, event_id))', 2)} AS last_ms
FROM events GROUP BY event_type""")
def q_metric_totals(spark, sf):
    return T.metric_totals(_timings(spark, sf))


# ======================================================= analytics N1–N7 ====
from trapline.operators import analytics as N  # noqa: E402

BANDS = [("type-0", 40, 90, 1, 6), ("type-1", 20, 70, 2, 7), ("type-2", 60, 95, 0, 3), ("type-3", 5, 95, 0, 10)]
TRUTH = [("type-0", ["preselection"], ["cookie_wall"], False),
         ("type-1", ["urgency", "privacy"], [], False),
         ("type-2", [], ["preselection", "urgency"], True),
         ("type-3", [], [], False)]


def report_store(spark, sf):
    """Stored report rows derived from orders / line items (overlay A)."""
    from trapline.sources.tables import read_table
    scans = fx.overlay_scans(spark, sf)
    n = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("scan_id")).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_patterns"))
    s = scans.join(n, "scan_id", "left")
    return s.select("scan_id", "url", "domain", F.col("raw_score").cast("bigint").alias("trust_score"),
                    R.grade(F.col("raw_score")).alias("grade"),
                    F.coalesce("total_patterns", F.lit(0).cast("bigint")).alias("total_patterns"),
                    R.risk_label(F.col("raw_score")).alias("risk_label"),
                    F.date_format("scan_ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                    F.concat(F.lit("type-"), (F.col("scan_id") % 4).cast("string")).alias("site_type"))


def store_sql() -> str:
    return O.overlay_a() + f""",
store AS (
  SELECT s.scan_id, s.url, s.domain, CAST(s.raw_score AS BIGINT) AS trust_score, {O.grade_sql('s.raw_score')} AS grade,
         CAST(coalesce(n.total_patterns, 0) AS BIGINT) AS total_patterns, {O.risk_label_sql('s.raw_score')} AS risk_label,
         strftime(s.scan_ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'type-' || CAST(s.scan_id % 4 AS VARCHAR) AS site_type
  FROM scans_a2 s LEFT JOIN (SELECT l_orderkey AS scan_id, count(*) AS total_patterns FROM lineitem GROUP BY l_orderkey) n
       USING (scan_id))"""


def bands_sql():
    rows = ", ".join(f"('{t}', {a}, {b}, {c}, {d})" for t, a, b, c, d in BANDS)
    return f"bands(site_type, min_score, max_score, min_patterns, max_patterns) AS (VALUES {rows})"


def bands_df(spark):
    return spark.createDataFrame(BANDS, "site_type string, min_score bigint, max_score bigint, "
                                        "min_patterns bigint, max_patterns bigint")


@register("history_page", "WITH " + store_sql() + """
SELECT * FROM (
  SELECT scan_id, url, domain, trust_score, grade, total_patterns, risk_label, timestamp,
         row_number() OVER (ORDER BY timestamp DESC, scan_id DESC) AS position FROM store)
WHERE position > 40 AND position <= 60""")
def q_history_page(spark, sf):
    return N.paged_history(report_store(spark, sf), page=3, limit=20)


@register("history_deep_page", "WITH " + store_sql() + """
SELECT * FROM (
  SELECT scan_id, url, domain, trust_score, grade, total_patterns, risk_label, timestamp,
         row_number() OVER (ORDER BY timestamp DESC, scan_id DESC) AS position FROM store)
WHERE position > 10800 AND position <= 11700""")
def q_history_deep_page(spark, sf):
    """N1 far from the newest: the ranges that page 13 of 900 lies in."""
    return N.paged_history(report_store(spark, sf), page=13, limit=900)


@register("top_categories", "WITH " + store_sql() + """,
last AS (SELECT scan_id FROM store ORDER BY timestamp DESC, scan_id DESC LIMIT 50),
c AS (SELECT category, CAST(count(*) AS BIGINT) AS n FROM raw_f WHERE scan_id IN (SELECT scan_id FROM last)
      AND coalesce(category, '') <> '' GROUP BY category)
SELECT * FROM (SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS rank FROM c) WHERE rank <= 5""")
def q_top_categories(spark, sf):
    out = N.top_categories(report_store(spark, sf), fx.overlay_findings(spark, sf))
    return out.select("category", "n", F.col("rank").cast("bigint").alias("rank"))


STATS_SQL = f"""SELECT CAST(count(*) AS BIGINT) AS total_scans,
       coalesce({O.rnd(O.exact_avg('CAST(trust_score AS DOUBLE)'), 1)}, 0.0) AS avg_trust_score,
       CAST(count_if(risk_label LIKE '%High%' OR risk_label LIKE '%Critical%') AS BIGINT) AS high_risk_count,
       CAST(coalesce(min(trust_score), 0) AS BIGINT) AS min_trust_score,
       CAST(coalesce(max(trust_score), 0) AS BIGINT) AS max_trust_score,
       coalesce({O.rnd(O.exact_avg('CAST(total_patterns AS DOUBLE)'), 1)}, 0.0) AS avg_patterns
FROM store"""


@register("global_stats", "WITH " + store_sql() + "\n" + STATS_SQL)
def q_global_stats(spark, sf):
    return N.global_stats(report_store(spark, sf))


@register("dashboard_summary", "WITH " + store_sql() + f""",
g AS ({STATS_SQL}),
last AS (SELECT scan_id, risk_label, row_number() OVER (ORDER BY timestamp DESC, scan_id DESC) AS pos
         FROM store ORDER BY timestamp DESC, scan_id DESC LIMIT 50),
d AS (SELECT risk_label, count(*) AS n, min(pos) AS first FROM last GROUP BY risk_label)
SELECT total_scans, avg_trust_score, max_trust_score AS highest_trust, min_trust_score AS lowest_trust,
       (SELECT risk_label FROM d ORDER BY n DESC, first LIMIT 1) AS most_common_risk,
       (SELECT string_agg(risk_label || ':' || CAST(n AS VARCHAR), ',' ORDER BY risk_label || ':' || CAST(n AS VARCHAR)) FROM d)
         AS risk_distribution,
       (SELECT string_agg(CAST(scan_id AS VARCHAR), ',' ORDER BY pos) FROM last WHERE pos <= 20) AS recent_scan_ids
FROM g""")
def q_dashboard(spark, sf):
    return N.dashboard(report_store(spark, sf))


EXPECT_SQL = "WITH " + store_sql() + ",\n" + bands_sql() + """,
e AS (
  SELECT scan_id, site_type, trust_score, total_patterns,
         concat_ws('; ',
           CASE WHEN trust_score < min_score THEN 'Score ' || CAST(trust_score AS VARCHAR) || ' below expected min '
                     || CAST(min_score AS VARCHAR) || ' (possible FALSE POSITIVES)'
                WHEN trust_score > max_score THEN 'Score ' || CAST(trust_score AS VARCHAR) || ' above expected max '
                     || CAST(max_score AS VARCHAR) || ' (possible FALSE NEGATIVES)' END,
           CASE WHEN total_patterns < min_patterns THEN 'Only ' || CAST(total_patterns AS VARCHAR)
                     || ' patterns found, expected ≥' || CAST(min_patterns AS VARCHAR) || ' (FALSE NEGATIVE risk)'
                WHEN total_patterns > max_patterns THEN CAST(total_patterns AS VARCHAR) || ' patterns found, expected ≤'
                     || CAST(max_patterns AS VARCHAR) || ' (FALSE POSITIVE risk)' END) AS notes
  FROM store JOIN bands USING (site_type))"""


@register("expectation_check", EXPECT_SQL + """
SELECT scan_id, site_type, trust_score, total_patterns, CASE WHEN notes = '' THEN 'PASS' ELSE 'WARN' END AS verdict, notes
FROM e""")
def q_expectation(spark, sf):
    return N.expectation_check(report_store(spark, sf), bands_df(spark))


@register("site_type_summary", EXPECT_SQL + f""",
v AS (SELECT *, CASE WHEN notes = '' THEN 'PASS' ELSE 'WARN' END AS verdict FROM e)
SELECT site_type, CAST(count_if(verdict = 'PASS') AS BIGINT) AS pass_count,
       CAST(count_if(verdict IN ('WARN', 'FAIL')) AS BIGINT) AS warn_count,
       CAST(count_if(verdict NOT IN ('PASS', 'WARN', 'FAIL')) AS BIGINT) AS error_count,
       coalesce({O.rnd(O.exact_avg('CAST(trust_score AS DOUBLE)'), 1)}, 0.0) AS avg_score
FROM v GROUP BY site_type""")
def q_site_summary(spark, sf):
    return N.site_type_summary(N.expectation_check(report_store(spark, sf), bands_df(spark)))


def _truth_sql():
    def arr(xs):
        return "CAST([" + ", ".join(O.q(x) for x in xs) + "] AS VARCHAR[])"
    rows = ", ".join(f"('{t}', {arr(m)}, {arr(n)}, {str(c).lower()})" for t, m, n, c in TRUTH)
    return f"truth(site_type, must_have, must_not_have, clean) AS (VALUES {rows})"


@register("rule_check", "WITH " + store_sql() + ",\n" + bands_sql() + ",\n" + _truth_sql() + """,
st AS (SELECT * FROM store JOIN bands USING (site_type) JOIN truth USING (site_type)),
fc AS (SELECT DISTINCT scan_id, category FROM raw_f),
req AS (SELECT scan_id, count(*) AS missing_required
        FROM (SELECT scan_id, unnest(must_have) AS category FROM st) x
        WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.scan_id = x.scan_id AND fc.category = x.category) GROUP BY scan_id),
forb AS (SELECT x.scan_id, count(*) AS forbidden_found
         FROM (SELECT scan_id, unnest(must_not_have) AS category FROM st) x JOIN raw_f r
              ON r.scan_id = x.scan_id AND r.category = x.category GROUP BY x.scan_id),
fs AS (SELECT r.scan_id, count_if(st.clean AND r.severity = 'CRITICAL') AS critical_on_clean,
              count_if(r.confidence < 0.50) AS low_confidence
       FROM raw_f r JOIN st USING (scan_id) GROUP BY r.scan_id),
j AS (
  SELECT st.scan_id, st.site_type, st.trust_score, st.total_patterns,
         CAST(CASE WHEN trust_score < min_score OR trust_score > max_score THEN 1 ELSE 0 END AS BIGINT) AS score_issue,
         CAST(CASE WHEN total_patterns > max_patterns OR total_patterns < min_patterns THEN 1 ELSE 0 END AS BIGINT) AS count_issue,
         CAST(coalesce(missing_required, 0) AS BIGINT) AS missing_required,
         CAST(coalesce(forbidden_found, 0) AS BIGINT) AS forbidden_found,
         CAST(coalesce(critical_on_clean, 0) AS BIGINT) AS critical_on_clean,
         CAST(coalesce(low_confidence, 0) AS BIGINT) AS low_confidence
  FROM st LEFT JOIN req USING (scan_id) LEFT JOIN forb USING (scan_id) LEFT JOIN fs USING (scan_id))
SELECT *, score_issue + count_issue + missing_required + forbidden_found + critical_on_clean + low_confidence AS issues,
       score_issue + count_issue + missing_required + forbidden_found + critical_on_clean + low_confidence = 0 AS passed
FROM j""")
def q_rule_check(spark, sf):
    truth = spark.createDataFrame(TRUTH, "site_type string, must_have array<string>, must_not_have array<string>, "
                                         "clean boolean").join(bands_df(spark), "site_type")
    out = N.rule_check(report_store(spark, sf), fx.overlay_findings(spark, sf), truth)
    return out


# ============================================== readability D29–D35 =========
from trapline.operators.detectors import readability as RD  # noqa: E402


def _rd_words_sql(t):
    return f"regexp_extract_all({t}, '[a-zA-Z'']+')"


def _rd_grade_sql(t="text"):
    words = _rd_words_sql(t)
    syl = (f"coalesce(list_sum(list_transform({words}, lambda w: CASE WHEN length(w) <= 3 THEN 1 ELSE "
           f"greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) - CASE WHEN ends_with(lower(w), 'e') THEN 1 "
           f"ELSE 0 END) END)), 0)")
    n_s = f"len(list_filter(string_split_regex({t}, '[.!?]+'), lambda s: regexp_matches(s, '\\S')))"
    return f"""CAST(len({words}) AS BIGINT) AS n_words, CAST({n_s} AS BIGINT) AS n_sentences,
       CAST({syl} AS BIGINT) AS n_syllables,
       CASE WHEN len({words}) = 0 OR {n_s} = 0 THEN 0.0 ELSE
         {O.rnd(f"0.39 * (len({words}) / {n_s}) + 11.8 * ({syl} / len({words})) - 15.59", 1)} END AS fk_grade"""


@register("readability_grades", f"""
SELECT doc_id, {_rd_grade_sql("coalesce(text, '')")} FROM documents""")
def q_readability_grades(spark, sf):
    from trapline.sources.tables import read_table
    return RD.readability_grades(read_table(spark, sf, "documents"))


def _rd_findings_sql():
    lw = _rd_words_sql("l")
    jarg = "[" + ", ".join(O.q(w) for w in RD.JARGON_WORDS) + "]"
    hits = f"len(list_filter({lw}, lambda w: list_contains({jarg}, w)))"
    dens = f"({hits} / greatest(len({lw}) / 1000.0, 0.5))"
    phr = O.count_contains("l", RD.JARGON_PHRASES)

    def anyre(pats):
        return "regexp_matches(l, " + O.q("(?:" + "|".join(f"(?:{p})" for p in pats) + ")") + ")"

    def row(tpl, cond, ev):
        typ, cat, sev, conf, el = tpl
        return (f"SELECT doc_id, {O.q(typ)} AS type, {O.q(cat)} AS category, {O.q(sev)} AS severity, "
                f"{O.dbl(conf)} AS confidence, {O.q(el)} AS element, {ev} AS evidence FROM g WHERE {cond}")
    g1 = "printf('%.1f', fk_grade)"
    return f"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents
           WHERE length(coalesce(text, '')) >= 0),
g AS (SELECT doc_id, l, {_rd_grade_sql("t")}, CAST(len({lw}) AS BIGINT) AS nlw,
             CASE WHEN len({lw}) > 0 THEN {dens} ELSE 0.0 END AS density, {phr} AS phr FROM b)
{row(RD.D30, "fk_grade >= 16", f"'FK Grade Level: ' || {g1} || '/20 (college graduate+ required to comprehend)'")}
UNION ALL {row(RD.D31, "fk_grade >= 14 AND fk_grade < 16", f"'FK Grade Level: ' || {g1} || '/20'")}
UNION ALL {row(RD.D32, "nlw > 0 AND (density > 5 OR phr >= 2)", f"'Jargon density: ' || printf('%.1f', {O.rnd('density', 1)}) || ' per 1000 words'")}
UNION ALL {row(RD.D33, anyre(RD.ARBITRATION_PATTERNS), "'The page text gives up court or class proceedings.'")}
UNION ALL {row(RD.D34, anyre(RD.PRICE_HIKE_PATTERNS), "'The page text names a first price and a later, higher one.'")}
UNION ALL {row(RD.D35, anyre(RD.EXIT_FEE_PATTERNS), "'The page text charges for leaving early.'")}"""


@register("readability_findings", _rd_findings_sql())
def q_readability_findings(spark, sf):
    from trapline.sources.tables import read_table
    return RD.readability_findings(read_table(spark, sf, "documents"))


# ======================================================= page path ==========
from trapline.operators.detectors import engines as E  # noqa: E402
from trapline.plans import page_scan as PS  # noqa: E402
from trapline.sources.planted import planted_pages, planted_pages_sql  # noqa: E402

TRACKER_SQL_NAMES = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(html, {O.q('(?i)' + p)}) THEN {O.q(n)} END" for p, n in E.TRACKERS) + "], lambda x: x IS NOT NULL)"


@register("page_extract")
def q_page_extract(spark, sf):
    """Bulk extraction; counts per page (rows-only check)."""
    ext = PS.extract(planted_pages(spark, sf), write=False)
    return ext.select("page_id", "page_title", F.length("text_content").cast("bigint").alias("text_chars"),
                      *[F.size(c).cast("bigint").alias(f"n_{c}") for c in
                        ["forms", "buttons", "links", "checkboxes", "timers", "prices", "text_elements"]])


@register("page_signals", "WITH " + planted_pages_sql() + f""",
s AS (SELECT page_id, url, html, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS domain,
             string_split(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', ''), '.') AS parts
      FROM planted)
SELECT page_id, domain,
       CASE WHEN len(parts) >= 2 THEN array_to_string(parts[len(parts) - 1:], '.') ELSE array_to_string(parts, '.') END AS apex,
       coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), domain) AS title,
       CASE WHEN {O.any_contains('lower(html)', E.AUTH_PHRASES)} THEN 'unauthenticated' ELSE 'unknown' END AS auth_state,
       TRY_CAST(coalesce(nullif(regexp_extract(html, {O.q(E.META_REFRESH)}, 1), ''), '-1') AS BIGINT) AS refresh_delay,
       array_to_string(list_distinct_ordered, ', ') AS trackers
FROM (SELECT *, {TRACKER_SQL_NAMES} AS list_distinct_ordered FROM s)""")
def q_page_signals(spark, sf):
    """S6 domain, S7 apex, S9 title (regex variant), S17 auth state, D16
    refresh delay and D26 tracker names — all regex over raw HTML."""
    p = planted_pages(spark, sf)
    dom = E._netloc(F.col("url"))
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return p.select(
        "page_id", dom.alias("domain"), E.apex(F.col("url")).alias("apex"),
        F.coalesce(F.nullif(title, F.lit("")), dom).alias("title"),
        E.auth_state(F.col("html")).alias("auth_state"),
        F.coalesce(F.nullif(F.regexp_extract("html", E.META_REFRESH, 1), F.lit("")), F.lit("-1")).try_cast("bigint")
        .alias("refresh_delay"),
        F.array_join(E.tracker_names(F.col("html")), ", ").alias("trackers"))


@register("visible_text_regex", "WITH " + planted_pages_sql() + """
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
         '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
         '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS visible_text
FROM planted""")
def q_visible_text_regex(spark, sf):
    """S8 regex variant: drop script/style blocks and tags, collapse spaces."""
    h = F.col("html")
    t = F.regexp_replace(h, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " ")
    return planted_pages(spark, sf).select("page_id", F.trim(t).alias("visible_text"))


@register("link_regex", "WITH " + planted_pages_sql() + """
SELECT page_id, CAST(len(h) AS BIGINT) AS n_links, array_to_string(h, ' ') AS hrefs
FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM planted)""")
def q_link_regex(spark, sf):
    """S12 regex variant: hrefs of <a> tags in document order."""
    h = F.regexp_extract_all(F.col("html"), F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)
    return planted_pages(spark, sf).select("page_id", F.size(h).cast("bigint").alias("n_links"),
                                           F.array_join(h, " ").alias("hrefs"))


DETECT_COLS = ["scan_id", "seq", "engine", "type", "category", "severity", "confidence", "element", "evidence",
               "is_critical"]


@register("detect_pages")
def q_detect_pages(spark, sf):
    """D1–D35 on extracted planted pages (rows-only; fixture tests assert
    the planted positives and negatives)."""
    return E.detect(PS.extract(planted_pages(spark, sf))).select(*DETECT_COLS)


@register("dom_snapshot_diff")
def q_dom_diff(spark, sf):
    """Original pages (before) vs planted pages (after)."""
    from trapline.sources.tables import read_table
    before = PS.extract(read_table(spark, sf, "pages"))
    after = PS.extract(planted_pages(spark, sf))
    return PS.snapshot_diff(before, after).select("scan_id", "type", "severity", "confidence", "evidence")


def _refresh_engine(page):
    """A custom engine: pages that send the visitor elsewhere; it fails on some."""
    if page["page_id"] % 7 == 3:
        raise ValueError(f"cannot read page {page['page_id']}")
    if 'http-equiv="refresh"' in (page["html"] or ""):
        yield {"type": "Forced Redirect", "category": "misdirection", "severity": "LOW", "confidence": 0.5, "element": "meta"}


def _button_engine(page):
    """A custom engine: one finding per button with a style of its own."""
    for b in page["buttons"]:
        if b["style"]:
            yield {"type": "Styled Button", "category": "visual_obstruction", "severity": "LOW", "confidence": 0.5, "element": "button", "evidence": b["text"]}


@register("custom_engines", "WITH " + planted_pages_sql() + """,
b AS (SELECT page_id, unnest(range(len(regexp_extract_all(html, '<button[^>]*style="[^"]+"[^>]*>[^<]+</button>')))) AS i FROM planted)
SELECT page_id AS scan_id, 'refresh' AS engine, 'ValueError: cannot read page ' || page_id AS outcome FROM planted WHERE page_id % 7 = 3
UNION ALL
SELECT page_id, 'refresh', 'Forced Redirect' FROM planted WHERE page_id % 7 <> 3 AND contains(html, 'http-equiv="refresh"')
UNION ALL
SELECT page_id, 'buttons', 'Styled Button' FROM b""")
def q_custom_engines(spark, sf):
    """Two custom engines beside the built-in ones, one of which fails on some
    pages: its error rows there, its findings elsewhere, the other's everywhere."""
    from trapline.operators.detectors import registry as Reg
    out = Reg.detect(PS.extract(planted_pages(spark, sf)), ["cookie"], {"refresh": _refresh_engine, "buttons": _button_engine})
    own = out.findings.where(F.col("erank") == fixed.CUSTOM_ENGINE_RANK).select("scan_id", "engine", F.col("type").alias("outcome"))
    return own.unionByName(out.errors.select("scan_id", "engine", F.col("error").alias("outcome")))


@register("quick_page_scan")
def q_quick_page_scan(spark, sf):
    """P2 over planted pages."""
    return PS.quick_page_scan(planted_pages(spark, sf)).select(*CONS_COLS[:-1], "rank_in_category")


@register("full_page_scan")
def q_full_page_scan(spark, sf):
    """P1 over planted pages: extract → detect (+S17/S18) → report."""
    from trapline.sources.tables import read_table
    return PS.full_page_scan(planted_pages(spark, sf), read_table(spark, sf, "pages")).select(*FULL_COLS)


# ===================================================== requests S2–S5 =======
from trapline.sources import requests as RQ  # noqa: E402


def _requests_sql() -> str:
    host = ("'Host' || CAST(user_id % 8 AS VARCHAR) || '.example.com/p' || CAST(event_id % 3 AS VARCHAR) "
            "|| CASE WHEN event_id % 2 = 0 THEN '/' ELSE '' END")
    u = "regexp_replace(coalesce(url, ''), '^\\s+|\\s+$', '', 'g')"
    pseudo = " ".join(f"WHEN starts_with(lower({u}), {O.q(p)}) THEN {O.q(f'Scheme {chr(39)}{p}{chr(39)} is not allowed. Only http and https are supported.')}"
                      for p in RQ.PSEUDO_SCHEMES)
    clean = (f"(CASE WHEN starts_with({u}, 'http://') OR starts_with({u}, 'https://') THEN {u} "
             f"ELSE 'https://' || {u} END)")
    netloc = f"regexp_extract({clean}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
    scheme = f"lower(split_part({u}, '://', 1))"
    return f"""req AS (
  SELECT event_id, ts,
         CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'ftp://' || {host}
              WHEN event_id % 17 = 0 THEN 'javascript:void(0)' WHEN event_id % 19 = 0 THEN '  ' || {host}
              WHEN event_id % 23 = 0 THEN 'https://' || {host} || ' x' ELSE 'https://' || {host} END AS url,
         CASE WHEN event_type = 'signup' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 END AS cookie_count,
         event_type = 'error' AS force_refresh
  FROM events),
v0 AS (
  SELECT *, CASE WHEN url IS NULL OR url = '' THEN {O.q(RQ.ERR_REQUIRED)}
                 WHEN length({u}) > {RQ.MAX_URL_LENGTH} THEN {O.q(RQ.ERR_LENGTH)}
                 WHEN contains({u}, '://') AND {scheme} NOT IN ('http', 'https')
                   THEN 'Scheme ''' || {scheme} || '://'' is not allowed. Only http and https are supported.'
                 {pseudo}
                 WHEN NOT regexp_matches({clean}, {O.q(RQ.URL_RE)}) THEN {O.q(RQ.ERR_FORMAT)}
                 WHEN {netloc} = '' THEN {O.q(RQ.ERR_HOST)}
                 WHEN cookie_count > {RQ.MAX_COOKIES} THEN {O.q(RQ.ERR_COOKIES)}
                 WHEN length(url) > {RQ.MAX_FIELD_CHARS} THEN {O.q(RQ.ERR_FIELD)} END AS error,
         {clean} AS _clean
  FROM req),
v AS (
  SELECT event_id, ts, url, cookie_count, force_refresh, error IS NULL AS ok, error,
         CASE WHEN error IS NULL THEN _clean END AS clean_url,
         CASE WHEN error IS NULL THEN substring(sha256(regexp_replace(regexp_replace(lower(_clean), '^\\s+|\\s+$', '', 'g'),
                                                '/+$', '')), 1, 32) END AS cache_key
  FROM v0)"""


@register("request_validation", "WITH " + _requests_sql() + """
SELECT event_id, ok, error, clean_url, cache_key FROM v""")
def q_request_validation(spark, sf):
    return RQ.validated_requests(RQ.request_overlay(spark, sf)).select(
        "event_id", "ok", "error", "clean_url", "cache_key")


SUPPRESS_SQL = "WITH RECURSIVE " + _requests_sql() + f""",
r AS (SELECT event_id, cache_key, force_refresh, cookie_count IS NOT NULL AS ck, epoch_us(ts) AS t,
             row_number() OVER (PARTITION BY cache_key ORDER BY ts, event_id) AS rn FROM v WHERE ok),
rec AS (
  SELECT cache_key, rn, event_id, false AS cache_hit, (NOT ck AND NOT force_refresh) AS cache_lookup,
         CASE WHEN ck THEN NULL ELSE t END AS lw
  FROM r WHERE rn = 1
  UNION ALL
  SELECT cache_key, rn, event_id, hit AS cache_hit, lookup AS cache_lookup,
         CASE WHEN ck OR hit THEN w ELSE t END AS lw
  FROM (SELECT r.cache_key, r.rn, r.event_id, r.ck, r.t, rec.lw AS w,
               (NOT r.ck AND NOT r.force_refresh) AS lookup,
               (NOT r.ck AND NOT r.force_refresh AND rec.lw IS NOT NULL AND r.t - rec.lw < {RQ.CACHE_TTL_SECONDS * 1_000_000})
                 AS hit
        FROM rec JOIN r ON r.cache_key = rec.cache_key AND r.rn = rec.rn + 1))"""


@register("repeat_scan_suppression", SUPPRESS_SQL + """
SELECT event_id, cache_key, cache_hit, cache_lookup FROM rec""")
def q_suppress(spark, sf):
    return RQ.suppress_repeats(RQ.validated_requests(RQ.request_overlay(spark, sf))).select(
        "event_id", "cache_key", "cache_hit", "cache_lookup")


@register("cache_stats", SUPPRESS_SQL + """
SELECT CAST(count_if(cache_hit) AS BIGINT) AS hits, CAST(count_if(cache_lookup) - count_if(cache_hit) AS BIGINT) AS misses,
       CASE WHEN count_if(cache_lookup) > 0 THEN round(count_if(cache_hit) / count_if(cache_lookup), 3) ELSE 0.0 END AS hit_rate,
       CAST(count(DISTINCT cache_key) AS BIGINT) AS keys
FROM rec""")
def q_cache_stats(spark, sf):
    return RQ.cache_stats(RQ.suppress_repeats(RQ.validated_requests(RQ.request_overlay(spark, sf))))


# ===================================================== ML M1–M6 =============
from trapline.operators import ml as M  # noqa: E402


def _chunks_sql() -> str:
    strip = O.strip("c")
    return f"""WITH p AS (SELECT doc_id, string_split_regex(coalesce(text, ''), {O.q(M.CHUNK_SPLIT)}) AS parts FROM documents),
e AS (SELECT doc_id, unnest(parts) AS c, unnest(range(len(parts))) AS chunk_no FROM p),
ch AS (SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, {strip} AS chunk FROM e)"""


@register("text_chunks", _chunks_sql() + """
SELECT * FROM ch WHERE length(chunk) > 0""")
def q_chunks(spark, sf):
    from trapline.sources.tables import read_table
    return M.chunks(read_table(spark, sf, "documents"))


def _features_sql() -> str:
    n1 = "(CAST(length(chunk) AS DOUBLE) + 1.0)"

    def frac(removed):
        return O.rnd(f"CAST(length(chunk) - length({removed}) AS DOUBLE) / {n1}", 6)
    low = "lower(chunk)"
    feats = [
        frac("replace(chunk, '!', '')"),
        frac("regexp_replace(chunk, '\\p{Lu}', '', 'g')"),
        frac("regexp_replace(chunk, '[0-9]', '', 'g')"),
        f"CAST({O.count_contains(low, M.URGENCY_WORDS)} AS DOUBLE)",
        f"CAST({O.count_contains(low, M.SHAME_WORDS)} AS DOUBLE)",
        O.rnd("least(len(string_split_regex(chunk, '\\s+')) / 50.0, 1.0)", 6),
        *[f"CASE WHEN regexp_matches({low}, {O.q(p)}) THEN 1.0 ELSE 0.0 END" for p in M.FLAG_PATTERNS],
    ]
    cols = ", ".join(f"{f} AS {n}" for f, n in zip(feats, M.FEATURE_COLS))
    return f"SELECT doc_id, chunk_no, chunk, {cols} FROM ch WHERE length(chunk) > 0"


@register("chunk_features", _chunks_sql() + "\n" + _features_sql())
def q_chunk_features(spark, sf):
    from trapline.sources.tables import read_table
    return M.chunk_features(M.chunks(read_table(spark, sf, "documents")))


def _trained(spark, sf):
    from trapline.sources.tables import read_table
    docs = ensure_parallelism(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    data = M.with_features(M.training_set(docs, read_table(spark, sf, "labels")), "text")
    train, test = M.stratified_split(data)
    model = M.fit_staged(M.build_pipeline(), train, ["label", "tf1", "tf2", *M.FEATURE_COLS])
    return model, test


@register("ml_chunk_predictions")
def q_ml_chunk_predictions(spark, sf):
    """M6 + M7: batch inference on every document chunk, then the
    safe/low-confidence filter, prefix dedupe and per-category floor."""
    from trapline.sources.tables import read_table
    model, _ = _trained(spark, sf)
    ch = M.chunk_features(M.chunks(read_table(spark, sf, "documents"))).withColumnRenamed("chunk", "text")
    pred = M.predict(model, ch).withColumnRenamed("text", "chunk")
    gated = M.gate_predictions(pred, {0.0: "safe", 1.0: "quality"})
    return gated.select("doc_id", "chunk_no", "category", round_half_up_col("confidence"))


def round_half_up_col(c):
    from trapline.functions.columns import round_half_up
    return round_half_up(F.col(c), 4).alias(c)


# ===================================================== streaming ============
from trapline.streaming import incremental as ST  # noqa: E402


def _orders_stream_path(sf):
    import os
    # a glob over the orders file: the file source lists it like a folder
    return os.path.join(sf, "orders.parque[t]")


@register("stream_trust_smoothing", ORACLES["trust_smoothing"])
def q_stream_smoothing(spark, sf):
    """T1/T2 as a stateful stream over the orders file (available-now);
    must equal the batch fold."""
    from trapline.sources.tables import read_table
    schema = read_table(spark, sf, "orders").schema
    o = ST.file_stream(spark, _orders_stream_path(sf), schema)
    scans = o.select(F.col("o_orderkey").alias("scan_id"),
                     F.concat(F.lit("site-"), F.col("o_custkey").cast("string")).alias("domain"),
                     F.col("o_orderdate").alias("scan_ts"),
                     (F.lit(5) + F.floor("o_totalprice").cast("bigint") % 91).cast("bigint").alias("raw_score"))
    path = ST.run_available_now(ST.smoothing_stream(scans), "stream-smoothing")
    return spark.read.parquet(path).select("scan_id", "domain", "raw_score", "smoothed_score", "history_depth")


@register("stream_request_dedupe", SUPPRESS_SQL + """
SELECT event_id, cache_key, cache_hit, cache_lookup FROM rec""")
def q_stream_dedupe(spark, sf):
    """S5 streaming: the request overlay over a file stream; must equal the
    batch fold."""
    import os
    from trapline.sources.tables import read_table
    schema = read_table(spark, sf, "events").schema
    ev = ST.file_stream(spark, os.path.join(sf, "events.parque[t]"), schema)
    req = RQ.validated_requests(RQ.request_overlay(spark, sf, ev))
    path = ST.run_available_now(ST.suppress_repeats_stream(req), "stream-dedupe")
    return spark.read.parquet(path).select("event_id", "cache_key", "cache_hit", "cache_lookup")


@register("report_upsert", """
SELECT user_id AS scan_id, arg_max(event_id, (ts, event_id)) AS event_id,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS write_ts,
       arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY user_id""")
def q_report_upsert(spark, sf):
    """S19 batch: last write wins per scan id (write ts, event id tie-break),
    as one pre-aggregated max_by per key."""
    from trapline.sources.tables import read_table
    ev = read_table(spark, sf, "events").select(F.col("user_id").alias("scan_id"), "event_id", "ts", "event_type",
                                                "value")
    best = F.max_by(F.struct("event_id", "ts", "event_type", "value"), F.struct("ts", "event_id"))
    r = ev.groupBy("scan_id").agg(best.alias("r"))
    return r.select("scan_id", "r.event_id", F.date_format("r.ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("write_ts"),
                    "r.event_type", "r.value")


# ============================================= S20, S21, R18, R19, F5 =======
ID_RE = r"^[A-Za-z0-9-]{1,64}$"


def _report_table(spark, sf):
    """Stored reports keyed 'scan-<user>' (the whole upserted table)."""
    r = q_report_upsert(spark, sf)
    return r.select(F.concat(F.lit("scan-"), F.col("scan_id").cast("string")).alias("report_id"),
                    F.to_json(F.struct("event_type", "value")).alias("report_json"))


@register("report_lookup", """
WITH ids AS (SELECT DISTINCT CASE WHEN event_id % 5 = 0 THEN 'scan-' || CAST(user_id AS VARCHAR) || '!'
                                  WHEN event_id % 7 = 0 THEN 'scan-' || repeat('x', 70)
                                  WHEN event_id % 3 = 0 THEN 'scan-' || CAST(user_id + 1000000000 AS VARCHAR)
                                  ELSE 'scan-' || CAST(user_id AS VARCHAR) END AS request_id FROM events),
rep AS (SELECT 'scan-' || CAST(user_id AS VARCHAR) AS report_id,
               arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value
        FROM events GROUP BY user_id)
SELECT request_id,
       CASE WHEN NOT regexp_matches(request_id, '^[A-Za-z0-9-]{1,64}$') THEN 'invalid'
            WHEN rep.report_id IS NULL THEN 'not_found' ELSE 'ok' END AS status,
       CASE WHEN regexp_matches(request_id, '^[A-Za-z0-9-]{1,64}$') THEN rep.event_type END AS event_type,
       CASE WHEN regexp_matches(request_id, '^[A-Za-z0-9-]{1,64}$') THEN rep.value END AS value
FROM ids LEFT JOIN rep ON rep.report_id = ids.request_id""")
def q_report_lookup(spark, sf):
    """Requested ids joined to the report table; malformed ids are
    rejected; the stored JSON is parsed back (round trip)."""
    from trapline.sources.tables import read_table
    ev = read_table(spark, sf, "events")
    rid = (F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("scan-"), F.col("user_id").cast("string"), F.lit("!")))
           .when(F.col("event_id") % 7 == 0, F.concat(F.lit("scan-"), F.lit("x" * 70)))
           .when(F.col("event_id") % 3 == 0,   # ids with no stored report
                 F.concat(F.lit("scan-"), (F.col("user_id") + 1000000000).cast("string")))
           .otherwise(F.concat(F.lit("scan-"), F.col("user_id").cast("string"))))
    ids = ev.select(rid.alias("request_id")).distinct()
    valid = F.col("request_id").rlike(ID_RE)
    j = ids.join(_report_table(spark, sf), ids.request_id == F.col("report_id"), "left")
    parsed = F.from_json("report_json", "event_type string, value double")
    return j.select("request_id",
                    F.when(~valid, "invalid").when(F.col("report_id").isNull(), "not_found").otherwise("ok")
                    .alias("status"),
                    F.when(valid, parsed["event_type"]).alias("event_type"),
                    F.when(valid, parsed["value"]).alias("value"))


@register("report_export", "WITH " + store_sql() + """
SELECT scan_id,
       to_json(struct_pack(scan_id := scan_id, domain := domain, trust_score := trust_score, grade := grade,
                           risk_label := risk_label, total_patterns := total_patterns)) AS json_line,
       concat_ws(' | ', CAST(scan_id AS VARCHAR), domain, 'score ' || CAST(trust_score AS VARCHAR), grade, risk_label,
                 CAST(total_patterns AS VARCHAR) || ' patterns') AS text_line
FROM store""")
def q_report_export(spark, sf):
    """Report rows as JSON lines and plain-text lines (write with
    ``df.write.text``)."""
    s = report_store(spark, sf)
    return s.select("scan_id",
                    F.to_json(F.struct("scan_id", "domain", "trust_score", "grade", "risk_label", "total_patterns"))
                    .alias("json_line"),
                    F.concat_ws(" | ", F.col("scan_id").cast("string"), "domain",
                                F.concat(F.lit("score "), F.col("trust_score").cast("string")), "grade", "risk_label",
                                F.concat(F.col("total_patterns").cast("string"), F.lit(" patterns"))).alias("text_line"))


def _views_oracle(severities: list[str] | None = None) -> str:
    """Views of the report findings ``f`` of the given severities."""
    keep = "" if severities is None else " WHERE severity IN (" + ", ".join(f"'{x}'" for x in severities) + ")"
    return _with_pipeline(*PIPE, O.report_ctes()) + f""",
f AS (SELECT * FROM rep{keep}),
c AS (SELECT scan_id, category, min({O.case_map('severity', fixed.REPORT_SEVERITY_ORDER, 5)} * 100000 + report_pos) AS k
      FROM f GROUP BY scan_id, category),
t AS (SELECT scan_id, string_agg(category, ',' ORDER BY k) AS top_categories
      FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY k) AS r FROM c) WHERE r <= 3 GROUP BY scan_id)
SELECT f.scan_id, CAST(count(*) AS BIGINT) AS findings, CAST(count_if(severity IN ('HIGH', 'CRITICAL')) AS BIGINT) AS high_critical,
       CAST(count_if(severity = 'CRITICAL') AS BIGINT) AS critical, any_value(t.top_categories) AS top_categories
FROM f JOIN t USING (scan_id) GROUP BY f.scan_id"""


def _report(spark, sf):
    return R.report_findings(_run(spark, sf).validated)


@register("finding_views", _views_oracle())
def q_finding_views(spark, sf):
    """Per scan, its findings, HIGH+CRITICAL and CRITICAL count and the first
    three distinct categories in severity-then-report order."""
    return R.finding_views(_report(spark, sf))


@register("finding_views_urgent", _views_oracle(["HIGH", "CRITICAL"]))
def q_finding_views_urgent(spark, sf):
    """The same over HIGH and CRITICAL findings only."""
    return R.finding_views(_report(spark, sf), ["HIGH", "CRITICAL"])


@register("findings_by_severity", _with_pipeline(*PIPE, O.report_ctes()) + """
SELECT scan_id, CAST(report_pos AS BIGINT) AS report_pos, type, category, severity, confidence FROM rep WHERE severity IN ('MEDIUM', 'LOW')""")
def q_findings_by_severity(spark, sf):
    """The finding list filtered to MEDIUM and LOW."""
    return R.by_severity(_report(spark, sf), ["MEDIUM", "LOW"]).select(
        "scan_id", F.col("report_pos").cast("bigint").alias("report_pos"), "type", "category", "severity", "confidence")


@register("category_details", _with_pipeline(*PIPE, O.report_ctes()) + """
SELECT c.scan_id, row_number() OVER (PARTITION BY c.scan_id ORDER BY n DESC, first) AS place, c.category,
       coalesce(i.name, list_aggregate(list_transform(string_split(replace(c.category, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ')) AS name,
       CAST(n AS BIGINT) AS findings, coalesce(l.refs, '') AS refs
FROM rcat c LEFT JOIN catinfo i USING (category)
LEFT JOIN (SELECT category, string_agg(DISTINCT ref, '; ' ORDER BY ref) AS refs FROM legal GROUP BY category) l USING (category)""")
def q_category_details(spark, sf):
    """Category breakdown with names and legal references."""
    return R.category_details(_report(spark, sf))


@register("engine_counts", _with_pipeline(O.overlay_a(), O.compound_ctes()) + """
SELECT scan_id, engine, CAST(count(*) AS BIGINT) AS findings FROM all_pre GROUP BY scan_id, engine""")
def q_engine_counts(spark, sf):
    """Raw findings per scan and engine."""
    return R.engine_counts(with_compound(_raw(spark, sf)))


@register("domain_history", _with_pipeline(O.overlay_a()) + f""",
h AS (SELECT domain, scan_id, raw_score AS score, row_number() OVER (PARTITION BY domain ORDER BY scan_ts DESC, scan_id DESC) AS place FROM scans_a2),
g AS (SELECT scan_id, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types,
             string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM raw_f GROUP BY scan_id)
SELECT domain, place, scan_id, score, CAST(coalesce(n, 0) AS BIGINT) AS findings, coalesce(types, '') AS types, coalesce(categories, '') AS categories
FROM h LEFT JOIN g USING (scan_id) WHERE place <= {fixed.TEMPORAL_WINDOW}""")
def q_domain_history(spark, sf):
    """Each domain's last scans with score, finding types and categories."""
    return T.domain_history(fx.overlay_scans(spark, sf), fx.overlay_findings(spark, sf))


ANCHOR_TAGS = ["p", "span", "div", "label", "h1", "h2", "h3", "h4", "h5", "h6", "li", "a", "button"]


@register("evidence_locate")
def q_evidence_locate(spark, sf):
    """For each quoted part (>= 3 characters) of a page finding's evidence,
    the first text element of an allowed tag that contains it (rows-only check)."""
    from trapline.operators.anchor import locate
    ext = PS.extract(planted_pages(spark, sf))
    quoted = F.regexp_extract_all("evidence", F.lit(r'"([^"]{3,})"'), 1)
    f = E.detect(ext).select("scan_id", "seq", "type", F.posexplode(quoted).alias("part_no", "needle"))
    pages = ext.select(F.col("page_id").alias("scan_id"), "text_elements")
    return locate(f, pages, "scan_id", "needle", tags=ANCHOR_TAGS).select(
        "scan_id", "seq", "type", F.col("part_no").cast("bigint").alias("part_no"), "needle", "element_index", "element_tag")


@register("signal_mean", _with_pipeline(*PIPE[:4]) + f"""
SELECT scan_id, CASE WHEN sum(w) > 0 THEN
         {O.rnd(f"greatest(0.0, least(1.0, {O.exact_sum('fusion_confidence * w')} / {O.exact_sum('w')}))", 3)}
         ELSE 0.0 END AS signal_mean
FROM (SELECT scan_id, fusion_confidence, {O.case_map('engine', fixed.FUSION_WEIGHTS, fixed.FUSION_DEFAULT_WEIGHT)} AS w
      FROM fused) GROUP BY scan_id""")
def q_signal_mean(spark, sf):
    """weighted mean of fused confidences, engine weights as weights."""
    fused = Fu.fuse(H.calibrate(with_compound(_raw(spark, sf))))
    return Fu.weighted_signal_mean(fused.withColumn("w", Fu.engine_weight()), ["scan_id"], "fusion_confidence", "w")


@register("ml_augment")
def q_ml_augment(spark, sf):
    """M4: seeded augmentation of the training part of the labelled documents
    (split first: no variant of a test document is ever trained on)."""
    from trapline.sources.tables import read_table
    tr, _ = M.stratified_split(M.training_set(read_table(spark, sf, "documents"), read_table(spark, sf, "labels")))
    return M.augment(tr.select("doc_id", "text", "label")).select(
        "doc_id", "label", "augmented", F.length("text").cast("bigint").alias("text_chars"))


@register("quick_scan", _with_pipeline(
    O.overlay_a(), "quick_pre AS (SELECT * FROM raw_f WHERE engine IN ('dom', 'cookie', 'advanced'))",
    O.calibrate_ctes("quick_pre"), O.fuse_ctes(), O.consensus_ctes()) + "\n" + _cons_select())
def q_quick_scan(spark, sf):
    """P2 on findings: dom + cookie + advanced engines only, calibrate →
    fuse → aggregate, no compound scorer or report."""
    v = P.quick_scan(fx.overlay_scans(spark, sf), fx.overlay_findings(spark, sf).repartition("scan_id"))
    return v.select(*CONS_COLS[:-1], F.col("rank_in_category").cast("bigint").alias("rank_in_category"))


def _regex_text(h):
    t = F.regexp_replace(h, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " "))


PAGE_RULE_TYPES = ["Hidden Cancellation Path", "Phone-Gate Cancellation", "Pricing Hidden Behind JS Gate",
                   "Subscription Upsell on Product Page", "Roach Motel — No Exit Path"]


def _page_rules_sql() -> str:
    text = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),"
            " '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))")
    sub = O.any_contains("c", E.SUBSCRIPTION_PAGE_KW)
    gate = O.q("(?s)(" + "|".join(E.JS_GATE_SELECTORS) + r")[^{}]{0,300}?" + E.JS_GATE_PRICE)
    prod = f"({O.any_contains('c', E.PRODUCT_PAGE_SIGNALS)} OR {O.any_contains('lower(url)', E.PRODUCT_PAGE_SIGNALS)})"
    rows = [
        ("Hidden Cancellation Path", f"{sub} AND NOT regexp_matches(c, {O.q('(?i)' + E.CANCEL_KEYWORDS)})"),
        ("Phone-Gate Cancellation", f"{sub} AND regexp_matches(c, {O.q('(?i)' + E.PHONE_GATE)}) AND "
                                    f"{O.any_contains('c', E.BILLING_PAGE_KW)}"),
        ("Pricing Hidden Behind JS Gate", f"regexp_matches(h, {gate})"),
        ("Subscription Upsell on Product Page", f"{prod} AND regexp_matches(c, {O.q('(?i)' + E.UPSELL_SIGNALS)})"),
        ("Roach Motel — No Exit Path", f"{O.any_contains('h', E.ACCOUNT_SIGNALS)} AND NOT {O.any_contains('h', E.EXIT_KEYWORDS)}"),
    ]
    body = "\nUNION ALL ".join(f"SELECT page_id, {O.q(t)} AS type FROM b WHERE {cond}" for t, cond in rows)
    return "WITH " + planted_pages_sql() + f""",
b AS (SELECT page_id, url, lower(html) AS h, lower(html) || ' ' || lower({text}) AS c FROM planted)
{body}"""


@register("page_rules_regex", _page_rules_sql())
def q_page_rules_regex(spark, sf):
    """D18, D20, D21, D22, D28 — the page-level advanced / link rules run by
    the same engine code over html plus the regex-variant visible text (no
    parser in the loop), so DuckDB can check the rule logic."""
    p = planted_pages(spark, sf)
    df = p.select("page_id", "url", "html", _regex_text(F.col("html")).alias("text_content"),
                  F.array().cast("array<struct<text:string,href:string,classes:string,style:string,"
                                 "font_size_hint:string>>").alias("links"))
    df = (df.withColumn("_html_l", F.lower("html"))
          .withColumn("_combined", F.concat(F.col("_html_l"), F.lit(" "), F.lower("text_content"))))
    items = F.concat(E.advanced_engine(), E.link_engine())
    out = df.select("page_id", F.explode(items).alias("f")).select("page_id", F.col("f.type").alias("type"))
    return out.where(F.col("type").isin(*PAGE_RULE_TYPES))


def _cookie_rules_sql() -> str:
    text = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),"
            " '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))")
    names = "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(html, {O.q('(?i)' + p)}) THEN {O.q(n)} END" for p, n in E.TRACKERS) + "], lambda x: x IS NOT NULL)"
    return "WITH " + planted_pages_sql() + f""",
b AS (SELECT page_id, html, {text} AS t FROM planted),
f AS (SELECT page_id, regexp_matches(t, {O.q(E.COOKIE_ACCEPT)}) AS acc, regexp_matches(t, {O.q(E.COOKIE_REJECT)}) AS rej,
             regexp_matches(t, {O.q(E.COOKIE_SETTINGS)}) AS sett, regexp_matches(t, {O.q(E.COOKIE_CONTEXT)}) AS ctx,
             list_distinct_ordered AS tr
      FROM (SELECT *, {names} AS list_distinct_ordered FROM b))
SELECT page_id, 'COOKIE_MANIPULATION' AS type,
       CASE WHEN acc AND NOT rej AND NOT sett AND ctx THEN 'cookie_wall' WHEN acc AND sett AND NOT rej AND ctx THEN 'privacy'
            ELSE 'cookie_wall' END AS category,
       CASE WHEN acc AND NOT rej AND NOT sett AND ctx THEN 'CRITICAL' WHEN acc AND sett AND NOT rej AND ctx THEN 'MEDIUM'
            ELSE 'HIGH' END AS severity, '' AS trackers
FROM f WHERE (acc AND NOT rej AND NOT sett AND ctx) OR (acc AND sett AND NOT rej AND ctx) OR (NOT rej AND NOT sett AND ctx)
UNION ALL
SELECT page_id, 'Tracking Before Consent', 'privacy', 'HIGH', array_to_string(tr, ', ')
FROM f WHERE len(tr) > 0 AND (NOT rej OR NOT ctx)"""


@register("cookie_rules_regex", _cookie_rules_sql())
def q_cookie_rules_regex(spark, sf):
    """D23–D26 — the cookie engine code over the regex-variant visible text
    (DuckDB-checkable; the parser-text form runs in ``detect_pages``)."""
    p = planted_pages(spark, sf)
    df = p.select("page_id", "html", _regex_text(F.col("html")).alias("consent_text"))
    out = df.select("page_id", F.explode(E.cookie_engine()).alias("f"))
    return out.select("page_id", F.col("f.type").alias("type"), F.col("f.category").alias("category"),
                      F.col("f.severity").alias("severity"),
                      F.when(F.col("f.type") == "Tracking Before Consent",
                             F.regexp_replace(F.col("f.evidence"), "^Trackers loading before consent: ", ""))
                      .otherwise(F.lit("")).alias("trackers"))


CB_RE = r'<label[^>]*>\s*<input([^>]*type="checkbox"[^>]*)>([^<]*)</label>'
BTN_RE = r"<button([^>]*)>([^<]*)</button>"
HIDDEN_RE = r'<input([^>]*type="hidden"[^>]*)>'


def _attr(a, name):
    return F.regexp_extract(a, name + '="([^"]*)"', 1)


@register("dom_rules_regex", "WITH " + planted_pages_sql() + f""",
cb AS (SELECT page_id, unnest(regexp_extract_all(html, {O.q(CB_RE)}, 1)) AS a,
              unnest(regexp_extract_all(html, {O.q(CB_RE)}, 2)) AS label FROM planted),
cbf AS (SELECT page_id, regexp_extract(a, 'name="([^"]*)"', 1) AS name, {O.strip('label')} AS label,
               lower({O.strip('label')}) AS l
        FROM cb WHERE regexp_matches(a, '\\bchecked\\b')),
bt AS (SELECT page_id, unnest(regexp_extract_all(html, {O.q(BTN_RE)}, 1)) AS a,
              unnest(regexp_extract_all(html, {O.q(BTN_RE)}, 2)) AS t FROM planted),
hi AS (SELECT page_id, unnest(regexp_extract_all(html, {O.q(HIDDEN_RE)}, 1)) AS a FROM planted),
hif AS (SELECT page_id, regexp_extract(a, 'name="([^"]*)"', 1) AS name, regexp_extract(a, 'value="([^"]*)"', 1) AS value
        FROM hi)
SELECT page_id, CASE WHEN {O.any_contains('l', E.MARKETING_KW)} THEN 'Pre-Selected Marketing Checkbox'
                     WHEN {O.any_contains('l', E.SUBSCRIPTION_KW)} THEN 'Pre-Selected Subscription Enrolment'
                     ELSE 'Pre-Selected Upsell / Add-On' END AS type,
       'input[type=checkbox][name="' || name || '"]' AS element
FROM cbf WHERE {O.any_contains('l', E.MARKETING_KW + E.SUBSCRIPTION_KW + E.UPSELL_KW)}
UNION ALL
SELECT page_id, 'Basket Sneaking (Hidden Field)', 'input[type=hidden][name="' || name || '"]'
FROM hif WHERE value <> '' AND ({O.any_contains('lower(name)', E.HIDDEN_FIELD_KW)} OR {O.any_contains('lower(value)', E.HIDDEN_FIELD_KW)})
UNION ALL
SELECT page_id, 'Confirmshaming Button', regexp_replace('button#' || regexp_extract(a, 'id="([^"]*)"', 1), '#+$', '')
FROM bt WHERE {O.strip('t')} <> '' AND {O.any_contains(f"lower({O.strip('t')})", E.SHAME_KW)}""")
def q_dom_rules_regex(spark, sf):
    """D1–D3, D6, D7 — the DOM engine code over regex-extracted checkboxes,
    buttons and hidden inputs (S11 / S13 regex variants; DuckDB-checkable)."""
    from trapline.functions.columns import py_strip
    p = planted_pages(spark, sf)
    h = F.col("html")
    cb = F.arrays_zip(F.regexp_extract_all(h, F.lit(CB_RE), 1).alias("a"),
                      F.regexp_extract_all(h, F.lit(CB_RE), 2).alias("label"))
    checkboxes = F.transform(cb, lambda x: F.struct(x["a"].rlike(r"\bchecked\b").alias("checked"),
                                                    _attr(x["a"], "name").alias("name"),
                                                    py_strip(x["label"]).alias("label"), F.lit("").alias("id")))
    bt = F.arrays_zip(F.regexp_extract_all(h, F.lit(BTN_RE), 1).alias("a"),
                      F.regexp_extract_all(h, F.lit(BTN_RE), 2).alias("t"))
    buttons = F.filter(F.transform(bt, lambda x: F.struct(py_strip(x["t"]).alias("text"), F.lit("").alias("classes"),
                                                          F.lit("").alias("style"), F.lit("button").alias("type"),
                                                          _attr(x["a"], "id").alias("id"))),
                       lambda b: b["text"] != "")
    hidden = F.transform(F.regexp_extract_all(h, F.lit(HIDDEN_RE), 1), lambda a: F.struct(
        F.lit("hidden").alias("type"), _attr(a, "name").alias("name"), F.lit(False).alias("checked"),
        F.lit(False).alias("required"), _attr(a, "value").alias("value"), F.lit("").alias("placeholder")))
    forms = F.array(F.struct(F.lit("").alias("action"), F.lit("get").alias("method"), F.lit("").alias("text"),
                             hidden.alias("inputs")))
    df = p.select("page_id", "html", checkboxes.alias("checkboxes"), buttons.alias("buttons"), forms.alias("forms"),
                  F.array().cast("array<struct<tag:string,text:string,classes:string,id:string>>").alias("timers"),
                  F.array().cast("array<struct<text:string,classes:string>>").alias("prices"),
                  F.lower("html").alias("_html_l"))
    out = df.select("page_id", F.explode(E.dom_engine()).alias("f"))
    return out.select("page_id", F.col("f.type").alias("type"), F.col("f.element").alias("element"))


A_RE = r"<a([^>]*)>([^<]*)</a>"


def _classes(a):
    return F.trim(F.regexp_replace(_attr(a, "class"), r"\s+", " "))


@register("visual_rules_regex", "WITH " + planted_pages_sql() + f""",
ln AS (SELECT page_id, unnest(regexp_extract_all(html, {O.q(A_RE)}, 1)) AS a,
              unnest(regexp_extract_all(html, {O.q(A_RE)}, 2)) AS t FROM planted),
lnf AS (SELECT page_id, trim(regexp_replace(regexp_extract(a, 'class="([^"]*)"', 1), '\\s+', ' ', 'g')) AS cls,
               regexp_extract(a, 'style="([^"]*)"', 1) AS style, {O.strip('t')} AS text FROM ln),
bt AS (SELECT page_id, unnest(regexp_extract_all(html, {O.q(BTN_RE)}, 1)) AS a,
              unnest(regexp_extract_all(html, {O.q(BTN_RE)}, 2)) AS t FROM planted),
btf AS (SELECT page_id, lower(trim(regexp_replace(regexp_extract(a, 'class="([^"]*)"', 1), '\\s+', ' ', 'g'))) AS cls,
               lower(regexp_extract(a, 'style="([^"]*)"', 1)) AS style, lower({O.strip('t')}) AS text
        FROM bt WHERE {O.strip('t')} <> ''),
agg AS (SELECT page_id,
               count_if({O.any_contains('text', E.ACCEPT_KW)} AND ({O.any_contains('cls', E.PROMINENT_KW)} OR {O.any_contains('style', E.PROMINENT_KW)})) AS acc,
               count_if({O.any_contains('text', E.REJECT_KW)} AND ({O.any_contains('cls', E.MUTED_KW)} OR {O.any_contains('style', E.MUTED_KW)})) AS rej,
               count_if(regexp_matches(style, {O.q('(?:' + '|'.join(f'(?:{p})' for p in E.URGENCY_COLOR_STYLES) + ')')})) AS urgent
        FROM btf GROUP BY page_id)
SELECT page_id, 'Fine Print Legal Link' AS type, 'a.' || replace(cls, ' ', '.') AS element
FROM lnf WHERE text <> '' AND {O.any_contains("lower(style) || lower(cls)", ['small', 'tiny', 'xs', 'text-xs', 'fine-print', 'footnote'])}
      AND {O.any_contains('lower(text)', E.FINE_PRINT_LEGAL_KW)}
UNION ALL SELECT page_id, 'Button Visual Misdirection', 'Button pair (visual hierarchy)' FROM agg WHERE acc >= 1 AND rej >= 1
UNION ALL SELECT page_id, 'Urgency Color Saturation', 'Multiple elements' FROM agg WHERE urgent >= 3""")
def q_visual_rules_regex(spark, sf):
    """D11, D13, D14 — the visual engine code over regex-extracted links and
    buttons (S11 / S12 regex variants; DuckDB-checkable)."""
    from trapline.functions.columns import py_strip
    from trapline.sources.extract import SMALL_LINK_KEYWORDS
    p = planted_pages(spark, sf)
    h = F.col("html")
    la = F.arrays_zip(F.regexp_extract_all(h, F.lit(A_RE), 1).alias("a"),
                      F.regexp_extract_all(h, F.lit(A_RE), 2).alias("t"))

    def link(x):
        cls, style = _classes(x["a"]), _attr(x["a"], "style")
        hint = F.when(E._has(F.concat(F.lower(style), F.lower(cls)), SMALL_LINK_KEYWORDS), "small").otherwise("normal")
        return F.struct(py_strip(x["t"]).alias("text"), _attr(x["a"], "href").alias("href"), cls.alias("classes"),
                        style.alias("style"), hint.alias("font_size_hint"))
    links = F.filter(F.transform(la, link), lambda l: l["text"] != "")
    bt = F.arrays_zip(F.regexp_extract_all(h, F.lit(BTN_RE), 1).alias("a"),
                      F.regexp_extract_all(h, F.lit(BTN_RE), 2).alias("t"))
    buttons = F.filter(F.transform(bt, lambda x: F.struct(py_strip(x["t"]).alias("text"), _classes(x["a"]).alias("classes"),
                                                          _attr(x["a"], "style").alias("style"),
                                                          F.lit("button").alias("type"), _attr(x["a"], "id").alias("id"))),
                       lambda b: b["text"] != "")
    df = p.select("page_id", links.alias("links"), buttons.alias("buttons"),
                  F.array().cast("array<struct<tag:string,text:string,classes:string>>").alias("text_elements"))
    out = df.select("page_id", F.explode(E.visual_engine()).alias("f"))
    return out.select("page_id", F.col("f.type").alias("type"), F.col("f.element").alias("element"))


TEXT_EL_RE = r"<(span|p|div)(\s[^>]*)?>([^<]*)</(?:span|p|div)>"


def _text_rules_sql() -> str:
    def any_re(expr, pats):
        return f"regexp_matches({expr}, {O.q('(?:' + '|'.join(f'(?:{p})' for p in pats) + ')')})"
    strip_t = O.strip("t")
    return "WITH " + planted_pages_sql() + f""",
te0 AS (SELECT page_id, regexp_extract_all(html, {O.q(TEXT_EL_RE)}, 1) AS tags,
               regexp_extract_all(html, {O.q(TEXT_EL_RE)}, 2) AS attrs,
               regexp_extract_all(html, {O.q(TEXT_EL_RE)}, 3) AS texts FROM planted),
te AS (SELECT page_id, unnest(tags) AS tag, unnest(attrs) AS a, unnest(texts) AS raw_t,
              unnest(range(len(tags))) AS i FROM te0),
te1 AS (SELECT page_id, tag, i, {O.strip('raw_t')} AS t,
               trim(regexp_replace(regexp_extract(a, 'class="([^"]*)"', 1), '\\s+', ' ', 'g')) AS cls FROM te),
el AS (SELECT * FROM te1 WHERE length(t) > 5),
ctx AS (SELECT page_id, lower(string_agg(t, ' ' ORDER BY i)) AS c FROM el WHERE t <> '' GROUP BY page_id),
unit AS (
  SELECT page_id, tag, i, cls, 0 AS j, t FROM el WHERE length(t) < {E.TEXT_MAX_LEN}
  UNION ALL
  SELECT page_id, tag, i, cls, unnest(range(len(s))), unnest(s)
  FROM (SELECT *, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM el WHERE length(t) >= {E.TEXT_MAX_LEN})),
cand AS (
  SELECT el.page_id, el.i, el.j, lower(el.t) AS low, lower({strip_t}) AS k, el.t,
         CASE WHEN el.cls <> '' THEN el.tag || ' .' || replace(el.cls, ' ', '.') ELSE el.tag END AS element,
         ({any_re('ctx.c', E.PRICE_CONTEXT)} OR {O.any_contains('ctx.c', E.CTA_KW)}
          OR {any_re('lower(el.t)', E.PRICE_CONTEXT)} OR {O.any_contains('lower(el.t)', E.CTA_KW)}) AS ok_ctx
  FROM unit el JOIN ctx USING (page_id) WHERE el.t <> ''),
typed AS (
  SELECT *, CASE WHEN {any_re('low', E.NUMERIC_SCARCITY)} THEN (CASE WHEN ok_ctx THEN 'Numeric Scarcity Claim' END)
                 WHEN {any_re('low', E.STANDALONE_URGENCY)} THEN 'Standalone Urgency Claim'
                 WHEN {O.any_contains('low', E.CONDITIONAL_PHRASES)}
                   THEN (CASE WHEN regexp_matches(low, '[0-9]+') AND ok_ctx THEN 'Urgency/Scarcity Messaging' END) END AS type
  FROM cand)
SELECT page_id, type, element FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, k ORDER BY i, j) AS r FROM typed WHERE type IS NOT NULL)
WHERE r = 1"""


@register("text_rules_regex", _text_rules_sql())
def q_text_rules_regex(spark, sf):
    """D8–D10 — the text engine code over regex-extracted leaf span / p / div
    elements (DuckDB-checkable variant of the parser path)."""
    from trapline.functions.columns import py_strip
    p = planted_pages(spark, sf)
    h = F.col("html")
    z = F.arrays_zip(F.regexp_extract_all(h, F.lit(TEXT_EL_RE), 1).alias("tag"),
                     F.regexp_extract_all(h, F.lit(TEXT_EL_RE), 2).alias("a"),
                     F.regexp_extract_all(h, F.lit(TEXT_EL_RE), 3).alias("t"))
    els = F.filter(F.transform(z, lambda x: F.struct(x["tag"].alias("tag"), py_strip(x["t"]).alias("text"),
                                                     _classes(x["a"]).alias("classes"))),
                   lambda e: F.length(e["text"]) > 5)
    df = p.select("page_id", els.alias("text_elements"))
    out = df.select("page_id", F.explode(E.text_engine()).alias("f"))
    return out.select("page_id", F.col("f.type").alias("type"), F.col("f.element").alias("element"))


LINK_RULE_TYPES = ["Dark Download Funnel", "Potential Software Bundling / PUA", "Buried Cancellation Link"]


def _link_rules_sql() -> str:
    text = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),"
            " '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))")

    def apex(u):
        host = f"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', '')"
        return (f"(CASE WHEN len(string_split({host}, '.')) >= 2 THEN array_to_string(string_split({host}, '.')"
                f"[len(string_split({host}, '.')) - 1:], '.') ELSE {host} END)")
    ext = f"(starts_with(href, 'http') AND NOT (href <> '' AND url <> '' AND {apex('href')} = {apex('url')}))"
    return "WITH " + planted_pages_sql() + f""",
pg AS (SELECT page_id, url, html, lower(html) || ' ' || lower({text}) AS c, html || ' ' || {text} AS bt FROM planted),
ln AS (SELECT page_id, unnest(regexp_extract_all(html, {O.q(A_RE)}, 1)) AS a,
              unnest(regexp_extract_all(html, {O.q(A_RE)}, 2)) AS t FROM planted),
lk AS (SELECT ln.page_id, pg.url, regexp_extract(a, 'href="([^"]*)"', 1) AS href, {O.strip('t')} AS text,
              trim(regexp_replace(regexp_extract(a, 'class="([^"]*)"', 1), '\\s+', ' ', 'g')) AS cls
       FROM ln JOIN pg USING (page_id) WHERE {O.strip('t')} <> ''),
lkf AS (SELECT *, {ext} AS ext FROM lk),
pl AS (SELECT page_id,
              bool_or(href <> '' AND ext AND regexp_matches(href, {O.q('(?i)' + E.REDIRECT_DOMAINS)})
                      AND {O.any_contains('lower(text)', E.DOWNLOAD_ANCHOR_KW)}) AS funnel,
              bool_or(ext AND {O.any_contains('lower(text)', E.EXTERNAL_DL_KW)}) AS ext_dl,
              count_if(regexp_matches(text, {O.q('(?i)' + E.CANCEL_KEYWORDS)})) AS n_cancel,
              count_if(regexp_matches(text, {O.q('(?i)' + E.CANCEL_KEYWORDS)})
                       AND NOT {O.any_contains('lower(cls)', E.BURIED_LINK_CLASSES)}) AS n_visible_cancel
       FROM lkf GROUP BY page_id),
j AS (SELECT pg.*, coalesce(funnel, false) AS funnel, coalesce(ext_dl, false) AS ext_dl,
             coalesce(n_cancel, 0) AS n_cancel, coalesce(n_visible_cancel, 0) AS n_visible_cancel
      FROM pg LEFT JOIN pl USING (page_id))
SELECT page_id, 'Dark Download Funnel' AS type, 'a[href] (download link)' AS element FROM j WHERE funnel
UNION ALL
SELECT page_id, 'Potential Software Bundling / PUA', 'a[href] + page text' FROM j
WHERE regexp_matches(bt, {O.q('(?i)' + E.BUNDLER_SIGNALS)}) AND ext_dl
UNION ALL
SELECT page_id, 'Buried Cancellation Link', 'footer a (cancel link)' FROM j
WHERE {O.any_contains('c', E.SUBSCRIPTION_PAGE_KW)} AND regexp_matches(c, {O.q('(?i)' + E.CANCEL_KEYWORDS)})
      AND n_cancel > 0 AND n_visible_cancel = 0
UNION ALL
SELECT page_id, 'Dark Download Funnel', 'Download Link' FROM lkf
WHERE contains(lower(href), 'download') AND NOT (starts_with(lower(href), '/') OR starts_with(lower(href), '#'))
      AND {O.any_contains('lower(href)', E.AD_DOMAINS)}"""


@register("link_rules_regex", _link_rules_sql())
def q_link_rules_regex(spark, sf):
    """D15, D17, D19, D27 — the advanced / link engine code over
    regex-extracted links and regex-variant text (DuckDB-checkable)."""
    from trapline.functions.columns import py_strip
    p = planted_pages(spark, sf)
    h = F.col("html")
    la = F.arrays_zip(F.regexp_extract_all(h, F.lit(A_RE), 1).alias("a"),
                      F.regexp_extract_all(h, F.lit(A_RE), 2).alias("t"))
    links = F.filter(F.transform(la, lambda x: F.struct(py_strip(x["t"]).alias("text"), _attr(x["a"], "href").alias("href"),
                                                        _classes(x["a"]).alias("classes"), F.lit("").alias("style"),
                                                        F.lit("normal").alias("font_size_hint"))),
                     lambda l: l["text"] != "")
    df = p.select("page_id", "url", "html", _regex_text(h).alias("text_content"), links.alias("links"))
    df = (df.withColumn("_html_l", F.lower("html"))
          .withColumn("_combined", F.concat(F.col("_html_l"), F.lit(" "), F.lower("text_content"))))
    out = df.select("page_id", F.explode(F.concat(E.advanced_engine(), E.link_engine())).alias("f"))
    out = out.select("page_id", F.col("f.type").alias("type"), F.col("f.element").alias("element"))
    return out.where(F.col("type").isin(*LINK_RULE_TYPES))


def _timer_price_sql() -> str:
    from trapline.sources import extract as X
    cls = "lower(trim(regexp_replace(regexp_extract(a, 'class=\"([^\"]*)\"', 1), '\\s+', ' ', 'g')))"
    idl = "lower(regexp_extract(a, 'id=\"([^\"]*)\"', 1))"
    timer = (f"({O.any_contains('cls', X.TIMER_CLASSES)} OR {O.any_contains('idl', X.TIMER_IDS)} "
             f"OR {O.any_contains('lower(t)', X.TIMER_TEXT_KEYWORDS)} "
             f"OR {O.any_contains('a', [d + '=' for d in X.TIMER_DATA_ATTRS])})")
    price = (f"(({O.any_contains('cls', X.PRICE_CLASS_KEYWORDS)} OR {O.any_contains('idl', X.PRICE_CLASS_KEYWORDS)}) "
             f"AND regexp_matches(t, {O.q(X.CURRENCY_RE.pattern)}))")
    return "WITH " + planted_pages_sql() + f""",
te0 AS (SELECT page_id, html, regexp_extract_all(html, {O.q(TEXT_EL_RE)}, 1) AS tags,
               regexp_extract_all(html, {O.q(TEXT_EL_RE)}, 2) AS attrs,
               regexp_extract_all(html, {O.q(TEXT_EL_RE)}, 3) AS texts FROM planted),
te AS (SELECT page_id, unnest(tags) AS tag, coalesce(unnest(attrs), '') AS a, {O.strip('unnest(texts)')} AS t FROM te0),
te1 AS (SELECT page_id, tag, a, t, {cls} AS cls, {idl} AS idl FROM te),
np AS (SELECT page_id, count_if({price}) AS n_prices FROM te1 GROUP BY page_id)
SELECT page_id, 'Countdown Timer / Fake Urgency' AS type, tag || '.' || cls AS element
FROM te1 WHERE {timer} AND {O.any_contains('lower(t)', E.TIMER_URGENCY_KW)}
UNION ALL
SELECT np.page_id, 'Potential Drip Pricing', 'Multiple price elements'
FROM np JOIN te0 USING (page_id) WHERE n_prices >= 3 AND {O.any_contains('lower(te0.html)', E.CHECKOUT_SIGNALS)}"""


@register("timer_price_rules_regex", _timer_price_sql())
def q_timer_price_rules_regex(spark, sf):
    """D4, D5 — the DOM engine's timer and drip-pricing rules over
    regex-extracted leaf elements (S14 / S15 regex variants)."""
    from trapline.functions.columns import py_strip
    from trapline.sources import extract as X
    p = planted_pages(spark, sf)
    h = F.col("html")
    z = F.arrays_zip(F.regexp_extract_all(h, F.lit(TEXT_EL_RE), 1).alias("tag"),
                     F.regexp_extract_all(h, F.lit(TEXT_EL_RE), 2).alias("a"),
                     F.regexp_extract_all(h, F.lit(TEXT_EL_RE), 3).alias("t"))
    els = F.transform(z, lambda x: F.struct(x["tag"].alias("tag"), F.coalesce(x["a"], F.lit("")).alias("a"),
                                            py_strip(x["t"]).alias("t")))

    def is_timer(e):
        c, i = F.lower(_classes(e["a"])), F.lower(_attr(e["a"], "id"))
        return (E._has(c, X.TIMER_CLASSES) | E._has(i, X.TIMER_IDS)
                | E._has(F.lower(e["t"]), X.TIMER_TEXT_KEYWORDS)
                | E._has(e["a"], [d + "=" for d in X.TIMER_DATA_ATTRS]))

    def is_price(e):
        c, i = F.lower(_classes(e["a"])), F.lower(_attr(e["a"], "id"))
        return ((E._has(c, X.PRICE_CLASS_KEYWORDS) | E._has(i, X.PRICE_CLASS_KEYWORDS))
                & e["t"].rlike(X.CURRENCY_RE.pattern))
    timers = F.transform(F.filter(els, is_timer), lambda e: F.struct(
        e["tag"].alias("tag"), e["t"].alias("text"), F.lower(_classes(e["a"])).alias("classes"),
        F.lower(_attr(e["a"], "id")).alias("id")))
    prices = F.transform(F.filter(els, is_price), lambda e: F.struct(e["t"].alias("text"),
                                                                    F.lower(_classes(e["a"])).alias("classes")))
    empty = "array<struct<{}>>"
    df = p.select("page_id", "html", timers.alias("timers"), prices.alias("prices"),
                  F.array().cast(empty.format("checked:boolean,name:string,label:string,id:string")).alias("checkboxes"),
                  F.array().cast(empty.format("text:string,classes:string,style:string,type:string,id:string"))
                  .alias("buttons"),
                  F.array().cast("array<struct<action:string,method:string,text:string,inputs:array<struct<type:string,"
                                 "name:string,checked:boolean,required:boolean,value:string,placeholder:string>>>>")
                  .alias("forms"),
                  F.lower("html").alias("_html_l"))
    out = df.select("page_id", F.explode(E.dom_engine()).alias("f"))
    return out.select("page_id", F.col("f.type").alias("type"), F.col("f.element").alias("element"))


from trapline.plans import ml_catalog  # noqa: E402,F401  registers its queries here
