"""Spark query vs independent DuckDB SQL on the same parquet tables."""

import pytest

from scripts.compare import rows_of
from tests.conftest import SF_SMALL
from trapline.plans.catalog import ORACLES, QUERIES

FAST = ["compound_patterns", "findings_calibrated", "calibration_stats", "fusion_findings", "fusion_category",
        "fusion_scan_score", "consensus_findings", "consensus_dedupe_cap", "report_findings", "scan_reports",
        "risk_assessment", "trust_smoothing", "full_scan", "temporal_trend", "history_summary",
        "persistent_findings", "rolling_metrics", "metric_totals", "history_page", "top_categories",
        "global_stats", "dashboard_summary", "expectation_check", "site_type_summary", "rule_check",
        "readability_grades", "readability_findings", "page_signals", "visible_text_regex", "link_regex",
        "request_validation", "repeat_scan_suppression", "cache_stats", "text_chunks", "chunk_features",
        "stream_trust_smoothing", "report_upsert", "report_lookup", "report_export", "finding_views",
        "signal_mean", "quick_scan", "page_rules_regex", "cookie_rules_regex", "dom_rules_regex", "visual_rules_regex",
        "text_rules_regex", "link_rules_regex", "timer_price_rules_regex", "ml_confusion", "ml_class_metrics", "ml_gate", "custom_engines"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, duck_small, name):
    sdf = QUERIES[name](spark, SF_SMALL).toPandas()
    ddf = duck_small.execute(ORACLES[name]).fetchdf()
    sc, sr = rows_of(sdf)
    dc, dr = rows_of(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    assert sorted(sr, key=key) == sorted(dr, key=key)


@pytest.mark.parametrize("name", ["full_scan", "readability_findings", "page_signals", "request_validation"])
def test_not_vacuous(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
