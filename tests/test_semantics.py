"""Operator rules on hand-built rows, an independent fold for smoothing and
partitioning invariance."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def _findings(spark, rows):
    cols = ("scan_id long, erank int, seq long, pos long, engine string, type string, category string, "
            "severity string, confidence double, element string, evidence string, description string, "
            "recommendation string, legal_refs array<string>, is_critical boolean")
    full = [(r[0], 0, i + 1, i + 1, r[1], r[2], r[3], r[4], r[5], r[6], "ev", "", "", [], False)
            for i, r in enumerate(rows)]
    return spark.createDataFrame(full, cols)


def test_calibration_rules(spark):
    from trapline.operators.calibrate import calibrate
    f = _findings(spark, [
        (1, "dom", "Pre-Selected Marketing Checkbox", "preselection", "MEDIUM", 0.61, "input"),  # critical override
        (1, "visual", "Disguised Advertisement", "disguised_ads", "MEDIUM", 0.9, "div.ad"),      # weak -> drop
        (1, "text", "Standalone Urgency Claim", "urgency", "MEDIUM", 0.9, "p"),                   # lone urgency
        (1, "behavioral", "Scan Incomplete", "informational", "INFORMATIONAL", 0.95, "document body"),
        (1, "advanced", "Hidden Cancellation Path", "obstruction", "HIGH", 0.60, "x"),            # below .65
    ])
    out = {r["type"]: r for r in calibrate(f).collect()}
    assert out["Pre-Selected Marketing Checkbox"]["severity"] == "CRITICAL"
    assert out["Pre-Selected Marketing Checkbox"]["note"].startswith("Critical override")
    assert "Disguised Advertisement" not in out
    assert "Standalone Urgency Claim" not in out
    assert "Scan Incomplete" in out
    assert "Hidden Cancellation Path" not in out


def test_trust_score_calibration_points(spark):
    from trapline.operators.report import trust_from_penalty
    df = spark.createDataFrame([(0.0,), (56.0,), (28.0,)], "p double")
    got = [r[0] for r in df.select(trust_from_penalty(F.col("p"))).collect()]
    assert got == [95, 37, 60]


def _py_smooth(scores, window=5, decay=0.85):
    out, hist = [], []
    for s in scores:
        if len(hist) <= 1:
            sm = s
        else:
            vals = [float(s)] + [float(h) for h in reversed(hist)]
            ws = [1.0] + [decay ** i for i in range(len(hist))]
            sm = round(sum(v * w for v, w in zip(vals, ws)) / sum(ws))
        out.append(sm)
        hist = (hist + [sm])[-window:]
    return out


def test_smoothing_matches_plain_python(spark):
    from trapline.operators.temporal import smooth_trust
    from trapline.sources.fixtures import overlay_scans
    scans = overlay_scans(spark, SF_SMALL).select("scan_id", "domain", "scan_ts", "raw_score")
    got = smooth_trust(scans, score="raw_score").toPandas()
    exp = []
    for _, g in got.sort_values(["domain", "scan_ts", "scan_id"]).groupby("domain"):
        exp.extend(zip(g.scan_id, _py_smooth(list(g.raw_score))))
    assert dict(exp) == dict(zip(got.scan_id, got.smoothed_score))


def test_partitioning_invariance(spark):
    from trapline.plans.catalog import QUERIES
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        a = sorted(map(tuple, QUERIES["full_scan"](spark, SF_SMALL).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = sorted(map(tuple, QUERIES["full_scan"](spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_request_validation_messages(spark):
    from trapline.sources.requests import validate
    df = spark.createDataFrame([(None,), ("ftp://x.com",), ("javascript:alert(1)",), ("example.com/a",),
                                ("https://bad host",)], "url string")
    ok, err, clean = validate(F.col("url"))
    rows = df.select(ok.alias("ok"), err.alias("e"), clean.alias("c")).collect()
    assert rows[0]["e"] == "Field 'url' is required."
    assert rows[1]["e"].startswith("Scheme 'ftp://'")
    assert rows[2]["e"].startswith("Scheme 'javascript:'")
    assert rows[3]["ok"] and rows[3]["c"] == "https://example.com/a"
    assert rows[4]["e"].startswith("Invalid URL format")


def test_extractor_rules():
    from trapline.sources.extract import extract_page
    d = extract_page('<html><title> T </title><body><p>a<b>b<div class="countdown">Hurry up</div>'
                     '<label><input type="checkbox" name="n" checked>News</label></body></html>', "https://h/x")
    assert d["page_title"] == "T"
    assert d["checkboxes"] == [{"checked": True, "name": "n", "label": "News", "id": ""}]
    assert any(t["classes"] == "countdown" for t in d["timers"])
    assert extract_page("<p>x</p>", "https://host.example/p")["page_title"] == "host.example"


def test_ml_rule_gate(spark):
    from trapline.operators.ml import rule_gate
    rows = [("privacy", 0.9, "we may sell data to partners", False, False, False),
            ("privacy", 0.9, "see ad choices", False, False, False),
            ("urgency", 0.9, "hurry only a few left", False, False, False),
            ("urgency", 0.9, "only 3 left", False, False, False),
            ("forced_continuity", 0.7, "plan details", False, False, False),
            ("social_proof", 0.75, "many people bought this", False, False, False)]
    df = spark.createDataFrame(rows, "c string, conf double, chunk string, t boolean, cb boolean, f boolean")
    g = df.select(rule_gate(F.col("c"), F.col("conf"), F.col("chunk"), F.col("t"), F.col("cb"), F.col("f"))
                  .alias("g")).collect()
    got = [(r.g.severity, r.g.type) for r in g]
    assert got[0] == ("HIGH", "ML: Privacy Manipulation")
    assert got[1][0] == "INFORMATIONAL"
    assert got[2][0] == "INFORMATIONAL" and got[3] == ("MEDIUM", "ML: Urgency")
    assert got[4][0] == "INFORMATIONAL"
    assert got[5][0] == "INFORMATIONAL"


def test_ml_anchor(spark):
    from trapline.operators.ml import anchor_element
    df = spark.createDataFrame(
        [("only 2 left in stock today", [("span", "only 2 left in stock today hurry", "b")])],
        "chunk string, els array<struct<tag:string,text:string,classes:string>>")
    r = df.select(anchor_element(F.col("chunk"), F.col("els")).alias("a")).collect()[0]
    assert r.a.tag == "span"


def test_chunks_keep_all_characters(spark):
    from trapline.operators.ml import chunks
    text = "Short. " + "long words " * 200 + ".\n\nAnother piece. x"
    got = "".join(r.chunk for r in chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_no").collect())
    drop = str.maketrans("", "", " .\n")
    assert got.translate(drop) == text.translate(drop)


def test_tracking_marks_are_their_own_list(spark):
    from trapline.operators.ml import page_ml_signals
    rows = [(1, "<script>ga('create', 1)</script>"), (2, "https://cdn.MIXPANEL.com/x"), (3, "<p>nothing</p>"), (4, None)]
    df = spark.createDataFrame([(*r, [], []) for r in rows], "page_id int, html string, checkboxes array<int>, forms array<int>")
    assert [r.has_tracking_scripts for r in page_ml_signals(df).orderBy("page_id").collect()] == [True, True, False, False]


def test_long_refresh_delay_does_not_fail(spark):
    from pyspark.sql import functions as F

    from trapline.operators.detectors import engines as E
    df = spark.createDataFrame([('<meta http-equiv="refresh" content="99999999999999999999">',)], "html string")
    assert df.select(F.regexp_extract("html", E.META_REFRESH, 1).try_cast("long").alias("d")).collect()[0].d is None


def test_extraction_is_whole_and_linear():
    import time
    from trapline.sources.extract import extract_page
    long = "word " * 200 + "hurry, offer ends soon"
    d = extract_page(f"<div><p>{long}</p><button>{long}</button><a href=x>{long}</a><form>{long}</form>"
                     f"<label><input type=checkbox>{long}</label></div>", "https://host.example/p")
    assert d["buttons"][0]["text"] == long and d["links"][0]["text"] == long and d["forms"][0]["text"] == long
    assert d["checkboxes"][0]["label"] == long
    # the form is no text tag: its text is the div's own
    assert [(t["tag"], t["text"]) for t in d["text_elements"]] == [(k, long) for k in ("div", "p", "button", "a", "label")]
    assert any(t["tag"] == "p" and t["text"] == long for t in d["timers"])
    assert extract_page("<p>Only&nbsp;2 left</p>", None)["text_content"] == "Only 2 left"

    def seconds(n):
        start = time.perf_counter()
        extract_page("<b>x " * n + "</i>" * n, None)
        return time.perf_counter() - start
    seconds(1000)
    assert seconds(16000) < 16 * 8 * max(seconds(1000), 0.002)


def test_text_engine_many_hits(spark):
    from pyspark.sql import functions as F
    from trapline.operators.detectors import engines as E
    rows = [(1, [("p", f"Only {i % 1600} left for $9", "") for i in range(3200)])]
    df = spark.createDataFrame(rows, "page_id int, text_elements array<struct<tag:string,text:string,classes:string>>")
    out = df.select(F.posexplode(E.text_engine()).alias("i", "f")).select("i", "f.evidence", "f.type").orderBy("i").collect()
    assert [r.evidence for r in out] == [f'"Only {i} left for $9"' for i in range(1600)]
    assert {r.type for r in out} == {"Numeric Scarcity Claim"}


def test_anomaly_finds_the_odd_chunks(spark):
    from pyspark.sql import functions as F
    from trapline.operators import ml as M
    import random
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(["plain", "Weather", "report", "no. 7", "rain!", "sun", "a", "must"]) for _ in range(draw.randint(5, 60))))
            for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id int, chunk string")
    odd = spark.createDataFrame([(1000, "!!!!!! HURRY ACT NOW 999999 !!!!!!!")], "doc_id int, chunk string")
    train = M.chunk_features(docs)
    out = M.anomaly_scores(train, train.unionByName(M.chunk_features(odd)))
    flagged = {r.doc_id for r in out.where("is_anomaly").select("doc_id").collect()}
    assert 1000 in flagged and len(flagged) < 50  # about 1 % of the normal rows


def test_caps_of_none_keep_every_finding(spark):
    from trapline.operators import consensus as A
    rows = [("s", "urgency", f"T{i}", f"el{i}", "same beginning " * 8 + str(i), "LOW", 0.5, i) for i in range(9)]
    df = spark.createDataFrame(rows, "scan_id string, category string, type string, _el string, evidence string, severity string, confidence double, k5 long")
    assert A.dedupe_and_cap(df, None, None).count() == 9
    assert A.dedupe_and_cap(df, 4, 2).count() == 4
    assert A.dedupe_and_cap(df, None, None, evidence_chars=60).count() == 1


def test_claims_in_long_elements_are_found(spark):
    """A claim after character 600 of one paragraph, on the parser path and as a
    column; a container that repeats it adds no second finding."""
    from pyspark.sql import functions as F

    from trapline.operators.detectors import engines as E
    from trapline.sources.extract import extract_pages
    prose = "A calm sentence about a walk in the park without any offer in it. " * 12
    text = prose + "Only 2 rooms left, reserve for $99! " + prose
    pages = spark.createDataFrame([(1, "https://a/b", f"<div><p>{text}</p><p>Only 2 rooms left, reserve for $99!</p></div>")], "page_id long, url string, html string")
    got = E.detect(extract_pages(pages), ["text"]).collect()
    assert [(r.type, r.evidence) for r in got] == [("Numeric Scarcity Claim", '"Only 2 rooms left, reserve for $99!"')]
    df = spark.createDataFrame([([("p", text, ""), ("p", "v1.5 is out", "")],)], "text_elements array<struct<tag:string,text:string,classes:string>>")
    out = df.select(E.claims(F.col("text_elements")).alias("c")).first().c
    assert " ".join(c.text for c in out[:-1]) == text.strip() + " " or "".join(c.text for c in out[:-1]).replace(" ", "") == text.replace(" ", "")
    assert out[-1].text == "v1.5 is out"


def test_evidence_is_whole(spark):
    from trapline.operators.detectors import engines as E
    from trapline.sources.extract import extract_pages
    label, prices = "Send me the newsletter " + "and more news " * 40, "".join(f'<span class="price">${i}.99</span>' for i in range(9))
    html = f'<label><input type="checkbox" name="n" checked>{label}</label><div class="cart">{prices}</div><p>checkout</p>'
    got = {r.type: r.evidence for r in E.detect(extract_pages(spark.createDataFrame([(1, "https://a/b", html)], "page_id long, url string, html string")), ["dom"]).collect()}
    assert label.strip() in got["Pre-Selected Marketing Checkbox"]
    assert "$8.99" in got["Potential Drip Pricing"] and "$0.99" in got["Potential Drip Pricing"]


def test_deep_pages_equal_the_sorted_list(spark, monkeypatch):
    import pytest

    from trapline.operators import analytics as N
    store = spark.range(700).selectExpr("concat('s', lpad(id, 4, '0')) as scan_id", "'u' as url", "'d' as domain", "id as trust_score", "'A' as grade",
                                        "id as total_patterns", "'low' as risk_label", "cast(id % 40 as long) as timestamp").repartition(5)
    want = [r.scan_id for r in store.orderBy("timestamp", "scan_id", ascending=False).collect()]
    monkeypatch.setattr(N, "NEAR_ROWS", 10)
    for page, limit in ((1, 60), (3, 100), (7, 100), (8, 100), (2, 650)):
        rows = sorted(N.paged_history(store, page, limit).collect(), key=lambda r: r.position)
        assert [r.scan_id for r in rows] == want[(page - 1) * limit:page * limit]
        assert [r.position for r in rows] == list(range((page - 1) * limit + 1, min(page * limit, 700) + 1))
    with pytest.raises(ValueError):
        N.paged_history(store, 1, 0)


def test_hot_key_is_folded_in_many_segments(spark):
    """One URL with most rows, dense stretches, gaps at the TTL exactly, cookies and
    forced refreshes: same flags as one fold over the key, in more than one task."""
    import random

    from pyspark.sql import functions as F

    from trapline.sources import requests as RQ
    r, ttl, rows, t = random.Random(8), 100, [], 0
    for i in range(3000):
        t += r.choice([0, 1, 5, 30, 60, 99, 100, 101, 250, 900]) if r.random() < 0.3 else 1
        rows.append((i, t, "hot" if r.random() < 0.7 else f"k{i % 5}", r.random() < 0.02, 3 if r.random() < 0.1 else None))
    df = spark.createDataFrame(rows, "event_id long, t long, cache_key string, force_refresh boolean, cookie_count int")
    df = df.select("event_id", F.timestamp_seconds("t").alias("ts"), "cache_key", "force_refresh", "cookie_count", F.lit(True).alias("ok"))
    want, last = {}, {}
    for i, t, k, force, cookies in rows:
        hit = cookies is None and not force and k in last and t - last[k] < ttl
        want[i] = (hit, cookies is None and not force)
        if cookies is None and not hit:
            last[k] = t
    out = RQ.suppress_repeats(df, ttl, 8).withColumn("task", F.spark_partition_id()).collect()
    assert {x.event_id: (x.cache_hit, x.cache_lookup) for x in out} == want
    assert len({x.task for x in out if x.cache_key == "hot"}) > 4


def test_finding_views_filter_by_severity(spark):
    from trapline.operators import report as R
    rows = [(1, 1, "urgency", "CRITICAL"), (1, 2, "privacy", "HIGH"), (1, 3, "nagging", "LOW"), (1, 4, "social_proof", "LOW"), (1, 5, "privacy", "CRITICAL"),
            (2, 1, "nagging", "LOW"), (2, 2, None, None)]
    rep = spark.createDataFrame(rows, "scan_id long, report_pos int, category string, severity string")
    view = lambda *a: {r.scan_id: tuple(r)[1:] for r in R.finding_views(rep, *a).collect()}
    assert view() == {1: (5, 3, 2, "urgency,privacy,nagging"), 2: (2, 0, 0, "nagging")}
    assert view(["HIGH", "CRITICAL"]) == {1: (3, 3, 2, "urgency,privacy")}
    assert view(["LOW"], 1) == {1: (2, 0, 0, "nagging"), 2: (1, 0, 0, "nagging")} and view([]) == {}
    assert R.by_severity(rep).count() == 7 and R.by_severity(rep, ["LOW"]).count() == 3


def test_domain_history_keeps_the_last_scans(spark):
    from trapline.operators import temporal as T
    scans = spark.createDataFrame([("a", i, i // 2, 50 + i) for i in range(8)] + [("b", 90, 1, 7), (None, 91, 1, 8)],
                                  "domain string, scan_id long, scan_ts long, raw_score long")
    found = spark.createDataFrame([(7, "t2", "c1"), (7, "t1", "c1"), (7, "t2", "c1"), (0, "gone", "gone"), (90, None, "c")],
                                  "scan_id long, type string, category string")
    got = {(r.domain, r.place): tuple(r)[2:] for r in T.domain_history(scans, found).collect()}
    assert [got["a", p][0] for p in range(1, 6)] == [7, 6, 5, 4, 3] and len(got) == 7
    assert got["a", 1] == (7, 57, 3, "t1,t2", "c1") and got["a", 2] == (6, 56, 0, "", "")
    assert got["b", 1] == (90, 7, 1, "", "c") and got[None, 1][0] == 91


def test_category_details_and_engine_counts(spark):
    from trapline.operators import report as R
    rep = spark.createDataFrame([(1, 1, "odd_one"), (1, 2, "privacy"), (1, 3, "privacy"), (1, 4, "urgency")], "scan_id long, report_pos int, category string")
    got = [tuple(r)[1:5] for r in R.category_details(rep).orderBy("place").collect()]
    assert [(g[0], g[1], g[3]) for g in got] == [(1, "privacy", 2), (2, "odd_one", 1), (3, "urgency", 1)] and got[1][2] == "Odd One"
    raw = spark.createDataFrame([(1, "dom"), (1, "dom"), (1, "text")], "scan_id long, engine string")
    assert sorted(map(tuple, R.engine_counts(raw).collect())) == [(1, "dom", 2), (1, "text", 1)]
