"""Streaming runs (available-now) equal their batch counterparts."""

import os

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_stream_smoothing_equals_batch(spark):
    from trapline.plans.catalog import QUERIES
    s = sorted(map(tuple, QUERIES["stream_trust_smoothing"](spark, SF_SMALL).collect()))
    b = sorted(map(tuple, QUERIES["trust_smoothing"](spark, SF_SMALL).collect()))
    assert s == b and len(s) > 0


def test_report_sink_last_write_wins(spark):
    from trapline.session import scratch_path
    from trapline.sources.tables import read_table
    from trapline.streaming import incremental as ST
    import uuid
    schema = read_table(spark, SF_SMALL, "events").schema
    ev = ST.file_stream(spark, os.path.join(SF_SMALL, "events.parque[t]"), schema)
    rows = ev.select(F.col("user_id").alias("scan_id"), F.col("ts").alias("write_ts"), "event_id", "event_type")
    run = uuid.uuid4().hex
    path = scratch_path(spark, f"sink-{run}/table")
    q = ST.report_sink_stream(rows, path, scratch_path(spark, f"sink-{run}/ckpt"))
    q.awaitTermination()
    latest = {r.scan_id: r.event_id for r in ST.latest_reports(spark, path).collect()}
    ev_b = read_table(spark, SF_SMALL, "events")
    exp = {r.user_id: r.e for r in ev_b.groupBy("user_id").agg(
        F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert latest == exp


def test_stream_suppression_equals_batch_over_several_batches(spark):
    """Five files, one per trigger: state is read back, and expires."""
    import uuid
    from trapline.session import scratch_path
    from trapline.sources import requests as RQ
    from trapline.sources.tables import read_table
    from trapline.streaming import incremental as ST
    ev = read_table(spark, SF_SMALL, "events")
    path = scratch_path(spark, f"events-{uuid.uuid4().hex}")
    cuts = [None, *ev.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).approxQuantile("t", [0.2, 0.4, 0.6, 0.8], 0.001), None]
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    for lo, hi in zip(cuts, cuts[1:]):
        part = ev if lo is None else ev.where(t >= lo)
        (part if hi is None else part.where(t < hi)).coalesce(1).write.mode("append").parquet(path)
    stream = ST.file_stream(spark, path, ev.schema, max_files=1)
    out = ST.run_available_now(ST.suppress_repeats_stream(RQ.validated_requests(RQ.request_overlay(spark, SF_SMALL, stream))), "s5")
    cols = ["event_id", "cache_key", "cache_hit", "cache_lookup"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*cols).collect()))
    exp = sorted(map(tuple, RQ.suppress_repeats(RQ.validated_requests(RQ.request_overlay(spark, SF_SMALL))).select(*cols).collect()))
    assert got == exp and len(got) > 0
