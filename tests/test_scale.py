"""Operators hold a bounded part of their input at a time and still give whole results."""

from __future__ import annotations

import pyarrow as pa

from trapline.sources import extract as X


def test_extraction_holds_a_slice_of_pages(spark):
    html = ["<p>one</p>", None, "", "<title>t</title><p>" + "x" * (3 * X.SLICE_BYTES) + "</p>"] * 25
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(100)), "html": html})
    parts = list(X.slices(batch, "html"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert max(p.num_rows for p in parts) <= X.SLICE_PAGES
    # no second page follows one that fills a slice
    assert all(sum(len(h or "") > X.SLICE_BYTES for h in p.column("html").to_pylist()) <= 1 for p in parts)
    small = pa.RecordBatch.from_pydict({"html": ["<p>a</p>"] * (2 * X.SLICE_PAGES + 1)})
    assert [p.num_rows for p in X.slices(small, "html")] == [X.SLICE_PAGES, X.SLICE_PAGES, 1]
    assert list(X.slices(small.slice(0, 0), "html")) == []

    rows = [(i, f"https://a{i}.example/", f"<title>t{i}</title><button>b{i}</button><p>text of {i}</p>" if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r for r in X.extract_pages(df).collect()}
    assert len(got) == 200
    for i, url, h in rows:
        want = X.extract_page(h, url)
        assert {k: [x.asDict() for x in v] if isinstance(v, list) else v for k, v in got[i].asDict().items() if k in want} == want


def test_dense_blocks_come_straight_from_the_vectors(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from trapline.operators import svd as S
    rows = [(i, Vectors.dense([float(i), 0.0, 2.0, 0.0, 1.0]) if i % 3 == 0 else Vectors.sparse(5, [1, 4], [float(i), -1.0]) if i % 3 == 1 else Vectors.sparse(5, [], []))
            for i in range(2 * S.ROWS + 7)]
    batch = pa.Table.from_batches(S._plain(spark.createDataFrame(rows, ["k", "v"]), "v").toArrow().to_batches()).combine_chunks().to_batches()[0]
    for cut in (batch, batch.slice(5), batch.slice(3, 0)):
        got = [(p.column("k").to_pylist(), x.copy(), sq) for p, x, sq in S._dense(cut, 5)]
        for keys, x, sq in got:
            want = np.array([rows[k][1].toArray() for k in keys])
            assert np.array_equal(x, want) and np.allclose(sq, (want * want).sum(axis=1))
        assert [k for keys, _, _ in got for k in keys] == cut.column("k").to_pylist()


def test_stream_smoothing_shares_state_groups(spark, tmp_path):
    """Domains of one state group keep their own histories, over several micro-batches."""
    from pyspark.sql import functions as F

    from trapline.operators import temporal as T
    from trapline.streaming import incremental as ST
    rows = [(i, None if i % 7 == 0 else f"site-{i % 7}", 1000 + i, (i * 37) % 96) for i in range(120)]
    df = spark.createDataFrame(rows, "scan_id long, domain string, t long, raw_score long").select("scan_id", "domain", F.timestamp_seconds("t").alias("scan_ts"), "raw_score")
    for k in range(3):
        df.where((F.col("scan_id") >= 40 * k) & (F.col("scan_id") < 40 * k + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ST.file_stream(spark, str(tmp_path / "in"), df.schema, max_files=1)
    cols = ["scan_id", "domain", "raw_score", "smoothed_score", "history_depth"]
    got = spark.read.parquet(ST.run_available_now(ST.smoothing_stream(stream, groups=2), "shared-groups")).select(cols)
    want = T.smooth_trust(df, score="raw_score").select(cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_dealt_by_key_keeps_tasks_small(spark):
    from trapline.session import dealt_by_key, materialize
    t = materialize(spark.range(10_000).selectExpr("id", "id % 500 AS k"), "dealt")
    big = dealt_by_key(t, "k", rows_per_task=100)
    assert big.rdd.getNumPartitions() == 100
    assert max(len(p) for p in big.rdd.glom().collect()) < 500
    assert big.count() == 10_000
    assert dealt_by_key(t, "k", rows_per_task=10_000).count() == 10_000


def test_hashed_features_do_not_depend_on_the_slices(spark, monkeypatch):
    from trapline.operators import text_features as F3
    rows = [(i, f"word{i} " * (i % 9) + "x" * (i % 50)) for i in range(120)] + [(120, None), (121, "")]
    df = spark.createDataFrame(rows, "k long, text string").coalesce(1)
    whole = [(r["k"], r["word_tf"], r["char_tf"]) for r in F3.hashed(df).orderBy("k").collect()]
    monkeypatch.setattr(F3, "SLICE_BYTES", 64)
    assert [(r["k"], r["word_tf"], r["char_tf"]) for r in F3.hashed(df).orderBy("k").collect()] == whole


def _own_findings(spark):
    from pyspark.sql import functions as F
    rows = [(i % 40, i, "dom text ml cookie".split()[i % 4], f"Type {i % 11}", "urgency hidden_costs obstruction privacy".split()[i % 3],
             "HIGH MEDIUM LOW CRITICAL".split()[i % 4], 0.6 + (i % 8) / 20, f"div.offer-{i % 5}", f"evidence {i % 9}") for i in range(400)]
    f = spark.createDataFrame(rows, "scan_id long, pos long, engine string, type string, category string, severity string, confidence double, element string, evidence string")
    f = f.select("scan_id", F.lit(0).alias("erank"), F.col("pos").alias("seq"), "pos", *f.columns[2:], F.lit("d").alias("description"), F.lit("r").alias("recommendation"),
                 F.array().cast("array<string>").alias("legal_refs"), F.lit(False).alias("is_critical"))
    scans = spark.range(45).selectExpr("id AS scan_id", "concat('s', id % 7) AS domain", "'unknown' AS scan_state", "'checkout cart shipping' AS page_text")
    return scans, f


def test_findings_chain_writes_nothing_for_one_reader_and_stays_compilable(spark):
    """A query that reads one table of the run writes no stage, and no generated method
    comes near 8,000 bytes, above which the JVM interprets it."""
    import contextlib
    import io
    import re

    from trapline.plans import full_scan as P
    from trapline.session import scratch_tables
    scans, f = _own_findings(spark)
    had = scratch_tables()
    run = P.run_findings(scans, f, materialize_stages=False)
    assert scratch_tables() == had
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            run.validated.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) < 6000
    written = P.run_findings(scans, f).validated
    rows = written.collect()
    assert len(rows) > 40 and sorted(map(str, rows)) == sorted(map(str, run.validated.select(*written.columns).collect()))


def test_risk_reads_the_findings_once(spark):
    from trapline.operators import risk as K
    rows = [(1, "HIGH", "urgency", 0.9, 0.5), (1, "HIGH", "urgency", 0.9, 0.5), (1, "LOW", "urgency", 0.7, None), (1, None, None, 0.8, 0.1), (None, "LOW", "privacy", 0.9, 0.2)]
    df = spark.createDataFrame(rows, "scan_id long, severity string, category string, confidence double, fusion_score double")
    out = K.risk_assessment(df)
    assert [(r.scan_id, r.finding_count, r.severity_distribution, r.category_distribution) for r in out.collect()] == [(1, 4, "HIGH:2,LOW:1", "urgency:3")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_readability_counts_in_one_pass_over_the_bytes(spark, monkeypatch):
    """The Arrow pass counts as the column expressions do, whatever the slices."""
    from pyspark.sql import functions as F

    from trapline.operators.detectors import readability as R
    odd = ["", " ", "...", "a.b.c", "!?.  \n .", "One. Two? three!\x0b.\x0b", "don't 'tis '' queue Ae e the eerie like", "İstanbul Kelvin été naïve",
           "日本。日本. x", "waiver Pursuant pursuant' waivers breach-breach", "after\x0b3 months, price\x0bwill be", "then $9.5 / month", "binding\narbitration",
           "you now waive every right é to a jury", "exit fee exit  fee", "A" * 5000 + ". " + "lie " * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd * 3)], "doc_id long, text string").coalesce(1)
    b = df.select("doc_id", F.col("text").alias("_t"), F.lower("text").alias("_l"))
    words = F.regexp_extract_all("_l", F.lit(R.WORD_RE), 0)
    want = b.select("doc_id", *R.grade_columns(F.col("_t")), F.size(words).cast("long").alias("n_low_words"),
                    F.size(F.filter(words, lambda w: w.isin(R.JARGON_WORDS))).cast("long").alias("n_jargon"),
                    *[F.col("_l").rlike("(?:" + "|".join(f"(?:{p})" for p in ps) + ")").alias(n) for n, ps in R.RULES.items()])
    want = sorted(want.collect())
    assert any(r.has_price_hike for r in want) and any(r.n_jargon for r in want)
    for size in (1 << 20, 40):
        monkeypatch.setattr(R, "SLICE_BYTES", size)
        got = R.with_counts(b, rules=True).withColumn("fk_grade", R.fk_grade()).select(*want[0].asDict())
        assert sorted(got.collect()) == want
    plan = R.readability_findings(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_extract_all" not in plan


def test_written_stage_keeps_no_shuffle_files(spark):
    """The shuffle files of a written table go when its write ends; the setting is put back."""
    from pyspark.sql import functions as F

    from trapline.session import materialize
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(key, None)

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {blocks.apply(i).getName() for i in range(blocks.size())}
    before = {x for x in shuffles() if x.startswith("shuffle_")}
    df = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(3, "k")
    kept = materialize(df, "kept")
    assert spark.conf.get(key, None) == had
    left = {x for x in shuffles() if x.startswith("shuffle_")} - before
    assert not left and kept.count() == 1000


def test_full_scan_keeps_its_reports_alone(spark):
    from pyspark.sql import functions as F

    from trapline.plans import full_scan as P
    from trapline.session import scratch_tables
    scans, f = _own_findings(spark)
    scans = scans.withColumn("scan_ts", F.timestamp_seconds("scan_id"))
    scans = scans.withColumn("url", F.lit("u"))
    before = set(scratch_tables())
    out = P.full_scan(scans, f)
    assert [t.rsplit("/", 1)[-1][:-33] for t in scratch_tables() if t not in before] == ["scan-reports"]
    run = P.run_findings(scans, f)
    rows = {r.scan_id: r for r in out.collect()}
    assert len(rows) == 45 and {r.scan_id: r.trust_score for r in run.reports.collect()} == {k: r.trust_score_raw for k, r in rows.items()}
