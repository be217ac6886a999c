"""Registration and isolation of engines."""

import pytest

from trapline.operators.detectors import engines as E
from trapline.operators.detectors import registry as R
from trapline.sources.extract import extract_pages

HTML = '<div class="bar">We use cookies. <button>Accept all</button></div><p>Flash sale, buy now</p>'


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://a/b", HTML), (2, "https://a/c", HTML), (3, "https://a/d", None)]
    return extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))


def _engines():
    """Defined in a call, so they go to the workers by value."""
    def loud(page):
        for i in range(2):
            yield {"type": f"T{i}", "category": "urgency", "severity": "LOW", "confidence": 0.5, "evidence": page["page_title"], "legal_refs": ["X"]}

    def breaks_late(page):
        yield {"type": "never seen", "category": "urgency", "severity": "LOW", "confidence": 0.5}
        if page["page_id"] == 2:
            raise RuntimeError("half way")

    def incomplete(page):
        yield {"type": "no category"}
    return loud, breaks_late, incomplete


loud, breaks_late, incomplete = _engines()


def test_one_failing_engine_costs_its_own_findings_only(pages):
    base = {(r.scan_id, r.engine, r.type, r.evidence) for r in E.detect(pages).collect()}
    out = R.detect(pages, custom={"loud": loud, "late": breaks_late, "bad": incomplete})
    rows = out.findings.collect()
    assert base and base <= {(r.scan_id, r.engine, r.type, r.evidence) for r in rows}
    own = sorted((r.scan_id, r.engine, r.type) for r in rows if r.erank == 8)
    assert own == sorted([(p, "loud", f"T{i}") for p in (1, 2, 3) for i in range(2)] + [(p, "late", "never seen") for p in (1, 3)])
    errors = {(r.scan_id, r.engine): r.error for r in out.errors.collect()}
    assert errors == {(2, "late"): "RuntimeError: half way", **{(p, "bad"): "ValueError: finding without category, severity, confidence" for p in (1, 2, 3)}}
    assert len({(r.scan_id, r.pos) for r in rows}) == len(rows)


def test_a_built_in_engine_that_cannot_be_built_is_an_error_row(pages, monkeypatch):
    def broken():
        raise KeyError("no such list")
    monkeypatch.setitem(E.ENGINES, "dom", broken)
    out = R.detect(pages, custom={})
    assert [(r.scan_id, r.engine) for r in out.errors.collect()] == [(None, "dom")]
    assert {r.engine for r in out.findings.collect()} >= {"cookie"}
    only = R.detect(pages, ["dom"], custom={})
    assert only.findings.collect() == [] and only.errors.count() == 1


def test_registration(pages):
    with pytest.raises(ValueError):
        R.register("cookie", loud)
    R.register("loud", loud)
    try:
        assert R.detect(pages, ["cookie"]).findings.where("engine = 'loud'").count() == 6
    finally:
        R.unregister("loud")
    assert R.detect(pages, ["cookie"]).findings.where("engine = 'loud'").count() == 0


def test_pages_that_do_not_parse_are_errors(pages):
    from pyspark.sql import functions as F
    odd = pages.withColumn("extract_error", F.when(F.col("page_id") == 1, "ValueError: x"))
    assert [(r.scan_id, r.engine, r.error) for r in R.detect(odd, ["cookie"], {}).errors.collect()] == [(1, "extract", "ValueError: x")]
    assert R.detect(odd.limit(0), custom={"loud": loud}).findings.collect() == []
