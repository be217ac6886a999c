"""T1–T7 — per-domain history, recursive trust smoothing, trends, rolling
metrics.

T2 is a true recurrence (the history holds *smoothed* scores), so it cannot
be a plain window.  It runs as a streaming fold: rows are hash-partitioned
by domain, sorted within the partition, and a ``mapInPandas`` pass carries a
bounded state (the last ``window`` smoothed scores) across Arrow batches.
Memory is O(window) per task no matter how many scans a domain has, and no
domain history is ever collected into one array or row.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.functions import fixed
from trapline.functions.columns import exact_avg, exact_sum, round_half_up


def _smoothing_fold(key: str, score: str, window: int, decay: float):
    powers = [decay ** i for i in range(window)]

    def fold(batches):
        cur = None
        hist: deque = deque(maxlen=window)
        for pdf in batches:
            keys = pdf[key].to_numpy()
            scores = pdf[score].to_numpy()
            out = np.empty(len(pdf), dtype=np.int64)
            depth = np.empty(len(pdf), dtype=np.int64)
            for i in range(len(pdf)):
                k = keys[i]
                if cur is None or k != cur[0]:
                    cur = (k,)
                    hist.clear()
                s = int(scores[i])
                depth[i] = len(hist)
                if len(hist) <= 1:
                    sm = s
                else:
                    vals = [float(s)] + [float(h) for h in reversed(hist)]
                    ws = [1.0] + powers[:len(hist)]
                    num = 0.0
                    for v, w in zip(vals, ws):
                        num += v * w
                    den = 0.0
                    for w in ws:
                        den += w
                    sm = int(round(num / den))
                out[i] = sm
                hist.append(sm)
            yield pdf.assign(smoothed_score=out, history_depth=depth)
    return fold


def smooth_trust(df: DataFrame, key: str = "domain", order=("scan_ts", "scan_id"),
                 score: str = "trust_score", window: int = fixed.TEMPORAL_WINDOW,
                 decay: float = fixed.TEMPORAL_DECAY, num_partitions: int | None = None) -> DataFrame:
    """T1+T2: add ``smoothed_score`` (the recorded score) and
    ``history_depth`` (entries recorded before this scan, capped at window).
    """
    order = list(order)
    parted = df.repartition(num_partitions, key) if num_partitions else df.repartition(key)
    parted = parted.sortWithinPartitions(key, *order)
    schema = T.StructType(df.schema.fields + [
        T.StructField("smoothed_score", T.LongType(), False),
        T.StructField("history_depth", T.LongType(), False)])
    return parted.mapInPandas(_smoothing_fold(key, score, window, decay), schema)


def _history_window(key: str, order, lo: int, hi: int):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(lo, hi)


def trend(smoothed: DataFrame, key: str = "domain", order=("scan_ts", "scan_id"),
          score: str = "smoothed_score", window: int = fixed.TEMPORAL_WINDOW) -> DataFrame:
    """T4: trend after recording each scan (window of the last ``window``
    recorded scores, current included); null fields when fewer than two."""
    order = [F.col(c) for c in order]
    w = _history_window(key, order, -(window - 1), 0)
    wo = Window.partitionBy(key).orderBy(*order)
    s = F.col(score)
    cnt = F.count(F.lit(1)).over(w)
    prev = F.lag(s, 1).over(wo)
    enough = cnt >= 2
    # scans without a trend (fewer than two recorded) get has_trend=false and
    # zero / 'none' fillers instead of nulls
    return smoothed.select(
        "*",
        enough.alias("has_trend"),
        cnt.cast("bigint").alias("trend_scan_count"),
        F.when(enough, prev).otherwise(F.lit(0)).cast("bigint").alias("previous_score"),
        F.when(enough, round_half_up(F.avg(s).over(w), 1)).otherwise(F.lit(0.0)).alias("average_score"),
        F.when(enough, F.when(s > prev, "improving").when(s < prev, "declining").otherwise("stable"))
        .otherwise("none").alias("trend"),
        F.when(enough, s - prev).otherwise(F.lit(0)).cast("bigint").alias("delta"),
    )


def history_summary(smoothed: DataFrame, key: str = "domain", order=("scan_ts", "scan_id"),
                    score: str = "smoothed_score", window: int = fixed.TEMPORAL_WINDOW) -> DataFrame:
    """T5: per domain, summary over the last ``window`` recorded scores.
    The newest-first top-k is a bounded WindowGroupLimit, then one group-by."""
    wd = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    last = smoothed.withColumn("_r", F.row_number().over(wd)).where(F.col("_r") <= window)
    return last.groupBy(key).agg(
        F.count(F.lit(1)).cast("bigint").alias("scans"),
        F.max(F.when(F.col("_r") == 1, F.col(score))).alias("latest_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        round_half_up(F.avg(score), 1).alias("avg_score"),
    )


def persistent_split(findings: DataFrame, scans: DataFrame, key: str = "domain",
                     order=("scan_ts", "scan_id"), window: int = fixed.TEMPORAL_WINDOW,
                     min_occurrences: int = 2) -> DataFrame:
    """Tag each current finding persistent / transient against the
    previous ``window`` scans of its domain.  A frame count over
    (domain, type) ordered by the scan's sequence number replaces the
    self-join: no pairs are materialised."""
    seqw = Window.partitionBy(key).orderBy(*order)
    seq = scans.select("scan_id", key, F.row_number().over(seqw).alias("scan_seq"))
    ft = findings.select("scan_id", "type").distinct().join(seq, "scan_id")
    w = (Window.partitionBy(key, "type").orderBy("scan_seq")
         .rangeBetween(-window, -1))
    counted = ft.withColumn("type_history_count", F.count(F.lit(1)).over(w).cast("bigint"))
    f = findings.join(counted.select("scan_id", "type", "scan_seq", "type_history_count"), ["scan_id", "type"])
    depth = F.least(F.col("scan_seq") - 1, F.lit(window))
    persistent = (depth < 2) | (F.col("type_history_count") >= min_occurrences)
    return f.withColumn("history_depth", depth.cast("bigint")).withColumn("persistent", persistent)


def rolling_metrics(timings: DataFrame, name: str = "name", ts: str = "ts", tie: str = "event_id",
                    value: str = "ms", window: int = fixed.METRIC_WINDOW) -> DataFrame:
    """Per metric name, stats over its last ``window`` samples.  The
    newest-first row_number filter becomes a partial WindowGroupLimit, so a
    name with billions of samples is cut to ``window`` rows per task before
    the shuffle."""
    w = Window.partitionBy(name).orderBy(F.col(ts).desc(), F.col(tie).desc())
    last = timings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= window)
    return last.groupBy(name).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"),
        round_half_up(exact_avg(F.col(value)), 2).alias("avg_ms"),
        round_half_up(F.min(value), 2).alias("min_ms"),
        round_half_up(F.max(value), 2).alias("max_ms"),
        round_half_up(F.max(F.when(F.col("_r") == 1, F.col(value))), 2).alias("last_ms"),
    )


def metric_totals(timings: DataFrame, name: str = "name", ts: str = "ts", tie: str = "event_id",
                  value: str = "ms", error_flag: str = "is_error") -> DataFrame:
    """Per name totals, error count and the last value (max_by on a
    unique (ts, tie) key); pre-aggregated map-side."""
    return timings.groupBy(name).agg(
        F.count(F.lit(1)).cast("bigint").alias("calls"),
        F.count_if(F.col(error_flag)).cast("bigint").alias("errors"),
        round_half_up(exact_sum(F.col(value)), 2).alias("total_ms"),
        round_half_up(F.max_by(F.col(value), F.struct(F.col(ts), F.col(tie))), 2).alias("last_ms"),
    )


def domain_history(scans: DataFrame, findings: DataFrame, score: str = "raw_score", last: int = fixed.TEMPORAL_WINDOW) -> DataFrame:
    """The ``last`` scans of each domain, newest first (place from 1): score, number of
    findings, and their types and categories (sorted, joined by ",").  Only scans that
    stay are joined to their findings, which are reduced to one row a scan before."""
    w = Window.partitionBy("domain").orderBy(F.desc("scan_ts"), F.desc("scan_id"))
    kept = scans.select("domain", "scan_id", "scan_ts", F.col(score).alias("score")).withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= last)
    per = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings"), *[
        F.array_join(F.array_sort(F.collect_set(c)), ",").alias(n) for c, n in (("type", "types"), ("category", "categories"))])
    return (kept.join(per, "scan_id", "left").select("domain", "place", "scan_id", "score", F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"),
                                                     F.coalesce("types", F.lit("")).alias("types"), F.coalesce("categories", F.lit("")).alias("categories")))
