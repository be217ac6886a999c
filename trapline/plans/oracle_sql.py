"""Independent DuckDB SQL for every registered query (the correctness
oracle).  Written directly from the operator semantics, not generated from
the Spark plans; shares only the fixed values."""

from __future__ import annotations

from trapline.functions import fixed
from trapline.sources import fixtures as fx


# ------------------------------------------------------------------ helpers --
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(vals) -> str:
    return "(" + ", ".join(q(v) for v in vals) + ")"


def any_contains(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(n)})" for n in needles) + ")"


def count_contains(expr: str, needles) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({expr}, {q(n)}) THEN 1 ELSE 0 END)" for n in needles) + ")"


def case_map(expr: str, mapping: dict, default) -> str:
    def lit(v):
        if isinstance(v, str):
            return q(v)
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    whens = " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {lit(default)} END)"


def rnd(expr: str, digits: int) -> str:
    s = float(10 ** digits)
    return f"(floor(({expr}) * CAST({s!r} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({s!r} AS DOUBLE))"


def exact_sum(expr: str, scale: int = 1_000_000_000) -> str:
    return (f"(CAST(sum(CAST(floor(({expr}) * CAST({float(scale)!r} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS DOUBLE)"
            f" / CAST({float(scale)!r} AS DOUBLE))")


def exact_avg(expr: str, scale: int = 1_000_000_000) -> str:
    return f"({exact_sum(expr, scale)} / CAST(count({expr}) AS DOUBLE))"


def title_case(expr: str) -> str:
    """Spark initcap over words separated by spaces."""
    return (f"array_to_string(list_transform(string_split({expr}, ' '), "
            f"lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ')")


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def dbl(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


SHIFT = 1 << 40


# -------------------------------------------------------------- overlay A --
def overlay_a(coarse: bool = False) -> str:
    """CTEs ``scans_a`` and ``raw_f``."""
    cat_rows = ",\n    ".join(
        f"({cid}, {q(e)}, {q(t)}, {q(c)}, {q(s)}, {p}, {q(el)})" for cid, e, t, c, s, p, el in fx.CATALOGUE)
    engine_rank = ("CASE WHEN cat_id IN (36, 37) THEN 10 ELSE "
                   + case_map("engine", {e: i for i, e in enumerate(fixed.ENGINE_ORDER)}, fixed.CUSTOM_ENGINE_RANK)
                   + " END")
    cols = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    if coarse:
        li = f"""li AS (
  SELECT *, l_orderkey % 1000 AS scan_id,
         row_number() OVER (PARTITION BY l_orderkey % 1000 ORDER BY l_orderkey, {cols}) AS seq,
         (l_partkey * 7 + l_suppkey * 3) % 39 AS cat_id
  FROM lineitem)"""
        scans = """scans_a AS (
  SELECT DISTINCT o_orderkey % 1000 AS scan_id FROM orders),
scans_a2 AS (
  SELECT scan_id, 'site-' || CAST(scan_id % 97 AS VARCHAR) AS domain,
         CASE WHEN scan_id % 3 = 0 THEN 'hotel room per night' WHEN scan_id % 3 = 1 THEN 'checkout cart shipping'
              ELSE 'plain page' END AS page_text,
         'unknown' AS scan_state
  FROM scans_a)"""
    else:
        li = f"""li AS (
  SELECT *, l_orderkey AS scan_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {cols}) AS seq,
         (l_partkey * 7 + l_suppkey * 3) % 39 AS cat_id
  FROM lineitem)"""
        scans = """scans_a2 AS (
  SELECT o_orderkey AS scan_id, 'site-' || CAST(o_custkey AS VARCHAR) AS domain,
         'https://site-' || CAST(o_custkey AS VARCHAR) || '.example/p/' || CAST(o_orderkey AS VARCHAR) AS url,
         o_orderdate AS scan_ts,
         5 + CAST(floor(o_totalprice) AS BIGINT) % 91 AS raw_score,
         CASE o_orderstatus WHEN 'P' THEN 'unauthenticated' WHEN 'F' THEN 'authenticated' ELSE 'unknown' END AS scan_state,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'hotel room per night' WHEN '2-HIGH' THEN 'checkout cart shipping'
              ELSE 'plain page' END AS page_text
  FROM orders)"""
    return f"""catalogue(cat_id, engine, type, category, severity, conf_pct, element) AS (VALUES
    {cat_rows}),
{li},
{scans},
raw_f AS (
  SELECT li.scan_id, {engine_rank} AS erank, CAST(li.seq AS BIGINT) AS seq,
         CAST({engine_rank} AS BIGINT) * {SHIFT} + li.seq AS pos,
         c.engine, c.type, c.category, c.severity,
         least(99, c.conf_pct + ((l_partkey + l_linenumber) % 7 - 3) * 5) / CAST(100.0 AS DOUBLE) AS confidence,
         CASE WHEN l_suppkey % 5 = 0 THEN 'div.offer-' || CAST(l_partkey % 3 AS VARCHAR) ELSE c.element END AS element,
         'evidence ' || CAST(l_partkey % 50 AS VARCHAR) AS evidence,
         c.type || ' detected' AS description,
         'Remove the ' || c.category || ' pattern' AS recommendation,
         CAST([] AS VARCHAR[]) AS legal_refs,
         cat_id IN (22, 24) AS is_critical
  FROM li JOIN catalogue c USING (cat_id))"""


# ------------------------------------------------------- compound (D36) --
def compound_ctes(src: str = "raw_f", brand: str = fixed.SUMMARY_BRAND) -> str:
    w = case_map("lower(category)", fixed.COMPOUND_CATEGORY_WEIGHTS, 1)
    ml = f"(contains(lower(engine), 'ml') AND lower(category) NOT IN {sql_list(fixed.COMPOUND_ML_EXEMPT_CATEGORIES)})"
    refs = "[" + ", ".join(q(r) for r in fixed.LEGAL_REFS[fixed.COMPOUND_CATEGORY]) + "]"
    return f"""cmp_v AS (
  SELECT scan_id, type, pos,
         CASE WHEN {ml} THEN 1 ELSE {w} END AS w,
         CASE WHEN {ml} THEN 'ml_signal' ELSE lower(category) END AS track
  FROM {src}
  WHERE erank < {fixed.COMPOUND_RANK} AND severity NOT IN ('INFORMATIONAL', 'LOW') AND category <> 'compound_pattern'),
cmp_t AS (
  SELECT scan_id, CAST(sum(w) AS BIGINT) AS total_weight, CAST(count(DISTINCT track) AS BIGINT) AS n_categories,
         bool_or(track IN {sql_list(fixed.COMPOUND_CRITICAL_CATEGORIES)}) AS high_harm
  FROM cmp_v GROUP BY scan_id
  HAVING sum(w) >= {fixed.COMPOUND_TRIGGER_WEIGHT} AND count(DISTINCT track) >= {fixed.COMPOUND_MIN_CATEGORIES}),
cmp_ty AS (
  SELECT scan_id, string_agg(type, ', ' ORDER BY p) AS types
  FROM (SELECT scan_id, type, p, row_number() OVER (PARTITION BY scan_id ORDER BY p) AS r
        FROM (SELECT scan_id, type, min(pos) AS p FROM cmp_v GROUP BY scan_id, type))
  GROUP BY scan_id),
cmp AS (
  SELECT t.scan_id, {fixed.COMPOUND_RANK} AS erank, CAST(1 AS BIGINT) AS seq,
         CAST({fixed.COMPOUND_RANK} AS BIGINT) * {SHIFT} + 1 AS pos,
         'behavioral' AS engine, {q(fixed.COMPOUND_TYPE)} AS type, {q(fixed.COMPOUND_CATEGORY)} AS category,
         CASE WHEN high_harm THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
         {rnd("least(0.95, 0.60 + 0.35 * (1.0 - exp(-CAST(total_weight AS DOUBLE) / 12.0)))", 3)} AS confidence,
         {q(fixed.COMPOUND_ELEMENT)} AS element,
         'Weighted score: ' || CAST(total_weight AS VARCHAR) || ' across ' || CAST(n_categories AS VARCHAR)
           || ' categories. Active vectors: ' || types || '.' AS evidence,
         {q(brand + ' detected ')} || CAST(n_categories AS VARCHAR)
           || ' independent dark pattern categories (weighted score: ' || CAST(total_weight AS VARCHAR)
           || ') operating together. ' || {q(fixed.COMPOUND_DESCRIPTION_TAIL)} AS description,
         {q(fixed.COMPOUND_RECOMMENDATION)} AS recommendation,
         {refs} AS legal_refs,
         false AS is_critical
  FROM cmp_t t JOIN cmp_ty y USING (scan_id)),
all_pre AS (SELECT * FROM {src} UNION ALL SELECT * FROM cmp)"""


# -------------------------------------------------------- calibration (H) --
def calibrate_ctes(src: str = "all_pre") -> str:
    trig = any_contains("lower(type)", fixed.CRITICAL_TYPE_TRIGGERS)
    weak = (f"((engine = 'ml' AND impact = 'LOW') OR {any_contains('lower(type)', fixed.WEAK_SIGNAL_FRAGMENTS)}"
            " OR (engine = 'readability' AND contains(lower(type), 'jargon') AND severity = 'MEDIUM'))")
    return f"""h1 AS (
  SELECT * REPLACE (coalesce(is_critical, false) OR {trig} AS is_critical),
         CASE WHEN {trig} THEN 'HIGH'
              WHEN category IN {sql_list(fixed.HIGH_IMPACT_CATEGORIES)} THEN 'HIGH'
              WHEN category IN {sql_list(fixed.MEDIUM_IMPACT_CATEGORIES)} THEN 'MEDIUM' ELSE 'LOW' END AS impact
  FROM {src}),
h1b AS (
  SELECT *,
         CASE WHEN type IN {sql_list(fixed.STRONG_INTENT_TYPES)} OR category IN {sql_list(fixed.STRONG_INTENT_CATEGORIES)}
                   OR is_critical THEN 'STRONG'
              WHEN severity IN ('HIGH', 'CRITICAL') OR impact = 'HIGH' THEN 'MODERATE' ELSE 'WEAK' END AS intent
  FROM h1),
h2 AS (
  SELECT *, (is_critical AND confidence >= 0.6) AS c_crit, severity = 'INFORMATIONAL' AS c_info,
         {weak} AS weak,
         confidence < (CASE WHEN impact = 'HIGH' THEN 0.65 ELSE 0.75 END) AS low_conf,
         impact = 'MEDIUM' AND intent = 'WEAK' AS down,
         impact = 'HIGH' AND intent = 'STRONG' AS up
  FROM h1b),
h3 AS (
  SELECT * EXCLUDE (c_crit, c_info, weak, low_conf, down, up) REPLACE (
           CASE WHEN c_crit AND severity NOT IN ('CRITICAL', 'HIGH') THEN 'CRITICAL'
                WHEN c_crit OR c_info THEN severity
                WHEN down AND severity IN ('HIGH', 'CRITICAL') THEN 'MEDIUM'
                WHEN down THEN severity
                WHEN up AND severity IN ('LOW', 'MEDIUM') THEN 'HIGH'
                ELSE severity END AS severity),
         severity AS raw_severity,
         CASE WHEN c_crit THEN {q(fixed.NOTE_CRITICAL)}
              WHEN c_info THEN {q(fixed.NOTE_INFORMATIONAL)}
              WHEN down THEN {q(fixed.NOTE_DOWNGRADED)}
              WHEN up THEN {q(fixed.NOTE_UPGRADED)}
              ELSE 'Accepted: ' || impact || ' impact / ' || intent || ' intent' END AS note
  FROM h2
  WHERE c_crit OR c_info OR NOT (weak OR low_conf OR impact = 'LOW')),
h4 AS (
  SELECT * EXCLUDE (_n) FROM (
    SELECT *, count(*) OVER (PARTITION BY scan_id, category) AS _n FROM h3)
  WHERE category NOT IN {sql_list(fixed.MULTI_SIGNAL_CATEGORIES)} OR _n >= 2),
h5 AS (
  SELECT *,
         NOT contains(note, 'Critical override') AND impact = 'HIGH' AND intent IN ('STRONG', 'MODERATE')
           AND severity IN ('LOW', 'MEDIUM') AS to_high,
         NOT contains(note, 'Critical override') AND impact = 'MEDIUM' AND intent = 'WEAK'
           AND severity IN ('CRITICAL', 'HIGH') AS to_med
  FROM h4),
cal AS (
  SELECT * EXCLUDE (to_high, to_med) REPLACE (
           CASE WHEN to_high THEN note || {q(fixed.NOTE_RECAL_HIGH)} WHEN to_med THEN note || {q(fixed.NOTE_RECAL_MEDIUM)}
                ELSE note END AS note,
           CASE WHEN to_high THEN 'HIGH' WHEN to_med THEN 'MEDIUM' ELSE severity END AS severity)
  FROM h5)"""


# ------------------------------------------------------------- fusion (F) --
def fuse_ctes(src: str = "cal") -> str:
    weight = case_map("engine", fixed.FUSION_WEIGHTS, fixed.FUSION_DEFAULT_WEIGHT)
    total = sum(fixed.FUSION_WEIGHTS.values())
    return f"""fu1 AS (
  SELECT *, max(confidence * {weight}) OVER (PARTITION BY scan_id, category, engine) AS _m,
         row_number() OVER (PARTITION BY scan_id, category, engine ORDER BY pos) = 1 AS _first
  FROM {src}),
fu2 AS (
  SELECT * EXCLUDE (_m, _first),
         least(1.0, CAST(sum(CAST(floor(CASE WHEN _first THEN _m END * CAST(1e9 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) OVER (PARTITION BY scan_id, category) AS DOUBLE) / CAST(1e9 AS DOUBLE) / {dbl(total)}) AS _cs,
         CAST(sum(CASE WHEN _first THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, category) AS BIGINT) AS engine_count
  FROM fu1),
fused AS (
  SELECT * EXCLUDE (_cs),
         CASE WHEN engine_count >= 3 THEN 0.10 WHEN engine_count >= 2 THEN 0.05 ELSE 0.0 END::DOUBLE AS conf_boost,
         {rnd("least(0.98, confidence + CASE WHEN engine_count >= 3 THEN 0.10 WHEN engine_count >= 2 THEN 0.05 ELSE 0.0 END::DOUBLE)", 3)} AS fusion_confidence,
         {rnd("_cs", 3)} AS fusion_score
  FROM fu2)"""


# ---------------------------------------------------------- consensus (A) --
def consensus_ctes(src: str = "fused", scans: str = "scans_a2", cap: int = fixed.MAX_PER_CATEGORY,
                   compound_cap: int = fixed.MAX_COMPOUND) -> str:
    t = "lower(coalesce(page_text, ''))"
    el = f"lower({strip('element')})"
    harm = (f"({any_contains('lower(type)', fixed.CRITICAL_FAILSAFE_TYPES)} OR "
            f"{any_contains('lower(category)', fixed.CRITICAL_FAILSAFE_TYPES)})")
    sev_rank = case_map("severity", fixed.SEVERITY_RANK, 1)
    return f"""a_ctx AS (
  SELECT scan_id,
         CASE WHEN {count_contains(t, fixed.BOOKING_CONTEXT_KEYWORDS)} >= 2 THEN 'booking'
              WHEN {count_contains(t, fixed.ECOMMERCE_CONTEXT_KEYWORDS)} >= 2 THEN 'ecommerce'
              ELSE 'generic' END AS context
  FROM {scans}),
a0 AS (
  SELECT *, {el} AS _el, lower(engine) AS _eng FROM {src} WHERE confidence >= 0.6),
a1 AS (
  SELECT *, _el NOT IN {sql_list(fixed.GENERIC_ELEMENTS)} AS _has_sel FROM a0),
a2 AS (
  SELECT *,
         CASE WHEN (_has_sel AND {any_contains('_el', fixed.STRUCTURAL_ELEMENT_MARKERS)})
                   OR contains(lower(type), 'multi') OR (contains(_eng, 'visual') AND _has_sel) THEN 'strong'
              WHEN contains(_eng, 'ml') AND NOT _has_sel THEN 'weak'
              WHEN _has_sel OR category IN ('preselection', 'cookie', 'tracking') THEN 'moderate'
              ELSE 'weak' END AS signal,
         CASE WHEN _el = '' THEN '__no_selector__' ELSE _el END AS ekey
  FROM a1),
a3 AS (
  SELECT a2.*, coalesce(c.context, 'generic') AS context,
         count(DISTINCT engine) OVER (PARTITION BY a2.scan_id, ekey) AS n_src,
         min(pos) OVER (PARTITION BY a2.scan_id, ekey) AS gpos,
         count(DISTINCT engine) OVER (PARTITION BY a2.scan_id, category) AS n_cat
  FROM a2 LEFT JOIN a_ctx c ON a2.scan_id = c.scan_id),
a4 AS (
  SELECT *,
         CASE WHEN severity = 'CRITICAL' AND confidence >= 0.6 AND {harm} THEN 'Failsafe: critical harm type'
              WHEN is_critical AND severity IN ('HIGH', 'CRITICAL') AND confidence >= 0.6 AND signal IN ('strong', 'moderate')
                THEN 'Failsafe: critical finding with a strong structural signal'
              WHEN greatest(n_src, n_cat) >= 2 THEN 'Consensus: ' || CAST(greatest(n_src, n_cat) AS VARCHAR) || ' engines'
              WHEN signal IN ('strong', 'moderate') AND context IN ('booking', 'ecommerce')
                THEN (CASE signal WHEN 'strong' THEN 'Strong' ELSE 'Moderate' END) || ' signal in ' || context || ' context'
              WHEN context IN ('booking', 'ecommerce') AND category IN ('urgency', 'social_proof') AND confidence >= 0.70
                THEN 'Context-aware single signal (' || category || ' in ' || context || ')'
              WHEN signal IN ('moderate', 'strong') AND severity = 'CRITICAL' THEN 'Single-engine CRITICAL with moderate+ signal'
              WHEN category = 'compound_pattern' AND severity IN ('HIGH', 'CRITICAL') THEN 'Compound pattern'
              WHEN _eng IN {sql_list(fixed.SPECIALIST_ENGINES)} AND category IN {sql_list(fixed.SPECIALIST_CATEGORIES)}
                   AND severity IN ('HIGH', 'CRITICAL') AND signal IN ('moderate', 'strong') AND confidence >= 0.70
                THEN 'Specialist engine (' || _eng || ') with strong evidence'
         END AS gate_reason
  FROM a3),
a5 AS (
  SELECT * EXCLUDE (n_src, n_cat),
         row_number() OVER (PARTITION BY scan_id ORDER BY gpos, confidence DESC, pos) AS k5
  FROM a4 WHERE gate_reason IS NOT NULL),
a6 AS (
  SELECT * FROM a5
  WHERE NOT (contains(_eng, 'ml') AND signal = 'weak') AND NOT (severity = 'INFORMATIONAL' AND NOT _has_sel)),
a7a AS (
  SELECT *, count(DISTINCT engine) OVER (PARTITION BY scan_id, category) AS n_cat2 FROM a6),
a7 AS (
  SELECT * EXCLUDE (n_cat2) REPLACE (
           CASE WHEN n_cat2 = 1 AND severity IN ('HIGH', 'CRITICAL') AND NOT (is_critical OR starts_with(gate_reason, 'Failsafe'))
                THEN 'MEDIUM' ELSE severity END AS severity),
         CASE WHEN n_cat2 >= 2 THEN 'Confirmed by ' || CAST(n_cat2 AS VARCHAR) || ' engines'
              WHEN n_cat2 = 1 AND severity IN ('HIGH', 'CRITICAL') AND NOT (is_critical OR starts_with(gate_reason, 'Failsafe'))
                THEN 'Single-engine signal - severity capped at MEDIUM' END AS consensus,
         CAST(n_cat2 AS BIGINT) AS consensus_engine_count,
         lower({strip('type')}) AS _tkey,
         _el IN {sql_list(fixed.GENERIC_ELEMENTS)} AS _generic,
         {strip("lower(coalesce(evidence, ''))")} AS _vkey
  FROM a7a),
a8 AS (
  SELECT * EXCLUDE (_r, k5) FROM (
    SELECT *, min(k5) OVER (PARTITION BY scan_id, category, _tkey) AS k8,
           row_number() OVER (PARTITION BY scan_id, category, _tkey ORDER BY confidence DESC, k5) AS _r
    FROM a7) WHERE _r = 1),
a9 AS (
  SELECT * EXCLUDE (_r, k8, _ek) FROM (
    SELECT *, CASE WHEN _generic THEN _tkey ELSE _el END AS _ek,
           min(k8) OVER (PARTITION BY scan_id, category, _generic, CASE WHEN _generic THEN _tkey ELSE _el END) AS k9,
           row_number() OVER (PARTITION BY scan_id, category, _generic, CASE WHEN _generic THEN _tkey ELSE _el END
                              ORDER BY confidence DESC, k8) AS _r
    FROM a8) WHERE _r = 1),
a10 AS (
  SELECT * EXCLUDE (_r, k9) FROM (
    SELECT *, min(k9) OVER (PARTITION BY scan_id, category, _vkey) AS k10,
           row_number() OVER (PARTITION BY scan_id, category, _vkey ORDER BY confidence DESC, k9) AS _r
    FROM a9) WHERE _r = 1),
validated AS (
  SELECT * EXCLUDE (_el, _eng, _has_sel, _tkey, _generic, _vkey) FROM (
    SELECT *, min(k10) OVER (PARTITION BY scan_id, category) AS cat_first,
           row_number() OVER (PARTITION BY scan_id, category ORDER BY {sev_rank} DESC, confidence DESC, k10) AS rank_in_category
    FROM a10)
  WHERE rank_in_category <= CASE WHEN category = 'compound_pattern' THEN {compound_cap} ELSE {cap} END)"""


# ------------------------------------------------------------- report (R) --
REST = ["advanced", "cookie", "link", "readability", "behavioral", "ml"]


def legal_refs_values() -> str:
    rows = ", ".join(f"({q(c)}, {q(r)})" for c, refs in fixed.LEGAL_REFS.items() for r in refs)
    return f"legal(category, ref) AS (VALUES {rows})"


def category_names_values() -> str:
    rows = ", ".join(f"({q(c)}, {q(v[0])}, {q(v[1])})" for c, v in fixed.CATEGORY_INFO.items())
    return f"catinfo(category, name, description) AS (VALUES {rows})"


def penalty_sql() -> str:
    return (f"(CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN "
            f"{case_map('severity', fixed.SEVERITY_WEIGHTS, 0.0)} * confidence * "
            f"{case_map('category', fixed.CATEGORY_MULTIPLIERS, 1.0)} ELSE 0.0 END)")


def trust_sql(p: str) -> str:
    return (f"greatest({fixed.TRUST_MIN}, least({int(fixed.TRUST_BASE)}, "
            f"CAST(round_even({dbl(fixed.TRUST_BASE)} * exp(-({p}) / {dbl(fixed.TRUST_DECAY_K)}), 0) AS BIGINT)))")


def grade_sql(s: str) -> str:
    whens = " ".join(f"WHEN {s} >= {t} THEN {q(g)}" for t, g in fixed.GRADE_BANDS)
    return f"(CASE {whens} ELSE {q(fixed.GRADE_FLOOR)} END)"


def risk_level_sql(s: str) -> str:
    whens = " ".join(f"WHEN {s} >= {t} THEN {q(lv)}" for t, lv, _ in fixed.RISK_BANDS)
    return f"(CASE {whens} ELSE {q(fixed.RISK_FLOOR[0])} END)"


def risk_label_sql(s: str) -> str:
    whens = " ".join(f"WHEN {s} >= {t} THEN {q(lb)}" for t, _, lb in fixed.RISK_BANDS)
    return f"(CASE {whens} ELSE {q(fixed.RISK_FLOOR[1])} END)"


def report_ctes(src: str = "validated", scans: str = "scans_a2", brand: str = fixed.SUMMARY_BRAND) -> str:
    bucket = ("CASE WHEN engine = 'dom' THEN 0 WHEN engine = 'text' THEN 1 WHEN engine = 'visual' THEN 2 "
              f"WHEN engine IN {sql_list(REST)} THEN 3 END")
    sev_order = case_map("severity", fixed.REPORT_SEVERITY_ORDER, 5)
    flags = []
    for i, (reg, _, cats) in enumerate(fixed.COMPLIANCE_RULES):
        flags.append(f"bool_or(category IN {sql_list(cats)}) AS _f{i}")
    flag_str = " || ".join(
        [f"(CASE WHEN coalesce(_f{i}, false) THEN {q(reg + ',')} ELSE '' END)"
         for i, (reg, _, _) in enumerate(fixed.COMPLIANCE_RULES)]
        + ["(CASE WHEN coalesce(_coppa, false) THEN 'COPPA,' ELSE '' END)"])
    sc = "CAST(trust_score AS VARCHAR)"
    summary = f"""CASE WHEN total_patterns = 0 THEN
  {q(brand + ' found no dark patterns on ')} || domain
  || '. The website appears to follow ethical, user-respecting design practices. Trust Score: ' || {sc}
  || '/100 (Grade: ' || grade || ').'
ELSE
  {q(brand + ' detected ')} || CAST(total_patterns AS VARCHAR) || ' dark pattern(s) across '
  || CAST(greatest(1, n_scored_categories) AS VARCHAR)
  || (CASE WHEN n_scored_categories = 1 THEN ' category on ' ELSE ' categories on ' END) || domain || '.'
  || (CASE WHEN n_critical > 0 THEN ' ' || CAST(n_critical AS VARCHAR) || ' CRITICAL issue(s) confirmed — direct user harm (forced consent, hidden charges or tracking without consent). Regulatory action risk is HIGH.' ELSE '' END)
  || (CASE WHEN n_high > 0 THEN ' ' || CAST(n_high AS VARCHAR) || ' HIGH finding(s) that take choices out of the visitor''s hands.' ELSE '' END)
  || (CASE WHEN n_medium > 0 THEN ' ' || CAST(n_medium AS VARCHAR) || ' MEDIUM finding(s) that press the visitor to act.' ELSE '' END)
  || (CASE WHEN n_low > 0 THEN ' ' || CAST(n_low AS VARCHAR) || ' LOW finding(s) to tidy up.' ELSE '' END)
  || ' Trust Score: ' || {sc} || '/100 — Grade: ' || grade || '.'
  || (CASE WHEN scan_state = 'unauthenticated' THEN ' Note: Limited scan due to missing user session. Some deep patterns may be hidden.' ELSE '' END)
END"""
    return f"""{legal_refs_values()},
{category_names_values()},
r0 AS (SELECT *, {bucket} AS bucket FROM {src}),
r1 AS (
  SELECT * EXCLUDE (_r2) FROM (
    SELECT *, row_number() OVER (PARTITION BY scan_id, type, category ORDER BY bucket, cat_first, rank_in_category) AS _r2
    FROM r0 WHERE bucket IS NOT NULL) WHERE _r2 = 1),
rep AS (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {sev_order}, confidence DESC, bucket, cat_first,
                                rank_in_category) AS report_pos
  FROM r1),
rc AS (
  SELECT scan_id, CAST(count(*) AS BIGINT) AS total_patterns,
         CAST(count_if(severity = 'CRITICAL') AS BIGINT) AS n_critical,
         CAST(count_if(severity = 'HIGH') AS BIGINT) AS n_high,
         CAST(count_if(severity = 'MEDIUM') AS BIGINT) AS n_medium,
         CAST(count_if(severity = 'LOW') AS BIGINT) AS n_low,
         CAST(count_if(severity = 'INFORMATIONAL') AS BIGINT) AS n_informational,
         CAST(count(DISTINCT CASE WHEN severity NOT IN ('INFORMATIONAL', 'LOW') THEN category END) AS BIGINT) AS n_scored_categories,
         {exact_sum(penalty_sql())} AS _p,
         bool_or(starts_with(type, {q(fixed.COPPA_TYPE_PREFIX)})) AS _coppa,
         {", ".join(flags)}
  FROM rep GROUP BY scan_id),
rcat AS (SELECT scan_id, category, count(*) AS n, min(report_pos) AS first FROM rep GROUP BY scan_id, category),
rcb AS (
  SELECT scan_id, string_agg(category || ':' || CAST(n AS VARCHAR), ';' ORDER BY n DESC, first) AS category_breakdown
  FROM rcat GROUP BY scan_id),
rreg AS (
  SELECT scan_id, string_agg(ref, '; ' ORDER BY ref) AS regulations_violated
  FROM (SELECT DISTINCT scan_id, ref FROM rcat JOIN legal USING (category)) GROUP BY scan_id),
rrec AS (
  SELECT scan_id, string_agg(recommendation, ' | ' ORDER BY first) AS top_recommendations
  FROM (SELECT scan_id, recommendation, first, row_number() OVER (PARTITION BY scan_id ORDER BY first) AS rr
        FROM (SELECT scan_id, recommendation, min(report_pos) AS first FROM rep
              WHERE coalesce(recommendation, '') <> '' GROUP BY scan_id, recommendation))
  WHERE rr <= 5 GROUP BY scan_id),
reng AS (
  SELECT scan_id, CAST(count_if(bucket = 0) AS BIGINT) AS dom_findings, CAST(count_if(bucket = 1) AS BIGINT) AS text_findings,
         CAST(count_if(bucket = 2) AS BIGINT) AS visual_findings, CAST(count_if(bucket = 3) AS BIGINT) AS elite_findings
  FROM r0 GROUP BY scan_id),
rj AS (
  SELECT s.scan_id, s.domain, s.scan_state,
         coalesce(total_patterns, 0) AS total_patterns, coalesce(n_critical, 0) AS n_critical,
         coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low,
         coalesce(n_informational, 0) AS n_informational, coalesce(n_scored_categories, 0) AS n_scored_categories,
         coalesce(category_breakdown, '') AS category_breakdown,
         coalesce(regulations_violated, '') AS regulations_violated,
         coalesce(top_recommendations, '') AS top_recommendations,
         coalesce(dom_findings, 0) AS dom_findings, coalesce(text_findings, 0) AS text_findings,
         coalesce(visual_findings, 0) AS visual_findings, coalesce(elite_findings, 0) AS elite_findings,
         CASE WHEN s.scan_state = 'unauthenticated' THEN least({trust_sql('coalesce(_p, 0.0)')}, {fixed.UNAUTHENTICATED_CAP})
              ELSE {trust_sql('coalesce(_p, 0.0)')} END AS trust_score,
         rtrim({flag_str}, ',') AS compliance_flags
  FROM {scans} s LEFT JOIN rc USING (scan_id) LEFT JOIN rcb USING (scan_id) LEFT JOIN rreg USING (scan_id)
       LEFT JOIN rrec USING (scan_id) LEFT JOIN reng USING (scan_id)),
rj2 AS (
  SELECT *, {grade_sql('trust_score')} AS grade, {risk_level_sql('trust_score')} AS risk_level,
         {risk_label_sql('trust_score')} AS risk_label FROM rj),
reports AS (SELECT *, {summary} AS summary FROM rj2)"""


# --------------------------------------------------------------- risk (K) --
def risk_ctes(src: str = "validated") -> str:
    sev = case_map("severity", fixed.RISK_SEVERITY_SCORES, fixed.RISK_UNKNOWN_SEVERITY_SCORE)
    has = ", ".join(f"bool_or(category = {q(c)}) AS _h_{c}" for c in
                    sorted({c for a, b, _ in fixed.RISK_COMPOUND_PAIRS for c in (a, b)}))
    bonus = "greatest(1.0, " + ", ".join(
        f"CASE WHEN _h_{a} AND _h_{b} THEN {dbl(m)} ELSE 1.0 END" for a, b, m in fixed.RISK_COMPOUND_PAIRS) + ")"
    norm = "least(1.0, greatest(0.0, 1.0 - exp(-(total_risk * compound_bonus) / 3.0)))"
    lv = " ".join(f"WHEN _norm >= {t} THEN {q(l)}" for t, l, _ in fixed.RISK_SCORE_BANDS)
    lb = " ".join(f"WHEN _norm >= {t} THEN {q(l)}" for t, _, l in fixed.RISK_SCORE_BANDS)
    return f"""k0 AS (
  SELECT scan_id, {exact_sum(f"{sev} * confidence * (0.7 + 0.3 * coalesce(fusion_score, 0.5))")} AS total_risk,
         CAST(count(*) AS BIGINT) AS finding_count, {has}
  FROM {src} GROUP BY scan_id),
k1 AS (SELECT scan_id, total_risk, finding_count, {bonus} AS compound_bonus FROM k0),
k2 AS (SELECT *, {norm} AS _norm FROM k1),
ksev AS (
  SELECT scan_id, string_agg(s, ',' ORDER BY s) AS severity_distribution
  FROM (SELECT scan_id, severity || ':' || CAST(count(*) AS VARCHAR) AS s FROM {src} GROUP BY scan_id, severity)
  GROUP BY scan_id),
kcat AS (
  SELECT scan_id, string_agg(s, ',' ORDER BY s) AS category_distribution
  FROM (SELECT scan_id, category || ':' || CAST(count(*) AS VARCHAR) AS s FROM {src} GROUP BY scan_id, category)
  GROUP BY scan_id),
risk AS (
  SELECT scan_id, finding_count, compound_bonus, {rnd('_norm', 3)} AS risk_score,
         CASE {lv} ELSE {q(fixed.RISK_SCORE_FLOOR[0])} END AS risk_level,
         CASE {lb} ELSE {q(fixed.RISK_SCORE_FLOOR[1])} END AS risk_label,
         severity_distribution, category_distribution
  FROM k2 JOIN ksev USING (scan_id) JOIN kcat USING (scan_id))"""


def smoothing_ctes(src: str, key: str = "domain", score: str = "score", order: str = "scan_ts, scan_id",
                   window: int = fixed.TEMPORAL_WINDOW, decay: float = fixed.TEMPORAL_DECAY) -> str:
    """T2 by recursive CTE: ``sm`` has (scan_id, smoothed_score, history_depth)."""
    powers = [decay ** i for i in range(window)]
    # num = cur*1.0 + h_newest*p0 + h_2*p1 + ... (left to right, like the fold)
    terms = []
    for i in range(window):
        idx = f"len(hist) - {i}"
        terms.append(f"(CASE WHEN len(hist) > {i} THEN CAST(hist[{idx}] AS DOUBLE) * {dbl(powers[i])} ELSE 0.0 END)")
    num = f"CAST(score AS DOUBLE) * 1.0 + " + " + ".join(terms)
    dens = []
    for k in range(2, window + 1):
        d = 0.0
        for w in [1.0] + powers[:k]:
            d += w
        dens.append(f"WHEN len(hist) = {k} THEN {dbl(d)}")
    den = "(CASE " + " ".join(dens) + " END)"
    return f"""sm_base AS (
  SELECT scan_id, {key} AS k, CAST({score} AS BIGINT) AS score,
         row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn
  FROM {src}),
sm_rec AS (
  SELECT k, rn, scan_id, score AS smoothed_score, CAST(0 AS BIGINT) AS history_depth, [score] AS hist
  FROM sm_base WHERE rn = 1
  UNION ALL
  SELECT k, rn, scan_id, smoothed_score, history_depth,
         CASE WHEN len(h2) > {window} THEN list_slice(h2, len(h2) - {window - 1}, len(h2)) ELSE h2 END AS hist
  FROM (
    SELECT b.k, b.rn, b.scan_id, CAST(len(s.hist) AS BIGINT) AS history_depth,
           CASE WHEN len(s.hist) <= 1 THEN b.score
                ELSE CAST(round_even(({num.replace('score', 'b.score').replace('hist', 's.hist')}) / {den.replace('hist', 's.hist')}, 0) AS BIGINT) END AS smoothed_score,
           list_append(s.hist, CASE WHEN len(s.hist) <= 1 THEN b.score
                ELSE CAST(round_even(({num.replace('score', 'b.score').replace('hist', 's.hist')}) / {den.replace('hist', 's.hist')}, 0) AS BIGINT) END) AS h2
    FROM sm_rec s JOIN sm_base b ON b.k = s.k AND b.rn = s.rn + 1)),
sm AS (SELECT scan_id, smoothed_score, history_depth FROM sm_rec)"""
