"""Structured Streaming forms of the stateful operators.

* S5  — repeat-request suppression with the last write of each cache key as
  state, by the batch fold's rule; state expires once the watermark has passed
  last write + TTL, when it can no longer serve a request.
* T1/T2 — per-domain trust smoothing with keyed state holding the last five
  recorded (smoothed) scores: ``applyInPandasWithState``; state size is O(5)
  per domain, domains share ``SMOOTH_GROUPS`` state rows by a hash, and groups
  are bounded by the micro-batch size.
* S19 — report sink: every micro-batch is appended with its write time by
  ``foreachBatch``; readers use the latest-per-scan view (last write wins).

All queries use the available-now trigger in tests and a checkpoint under the
shared ``spark.checkpoint.dir`` (never a machine-local folder), so a restart
resumes from the committed offsets and state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trapline.functions import fixed
from trapline.session import scratch_path
from trapline.sources.requests import CACHE_TTL_SECONDS


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 64) -> DataFrame:
    """Parquet files arriving under ``path`` (a directory or glob)."""
    return (spark.readStream.format("parquet").schema(schema)
            .option("maxFilesPerTrigger", max_files).load(path))


# ----------------------------------------------------------------- S5 -------
SUPPRESS_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("cache_key", T.StringType()),
    T.StructField("cache_hit", T.BooleanType()), T.StructField("cache_lookup", T.BooleanType())])
SUPPRESS_STATE = T.StructType([T.StructField("last_write", T.LongType())])


def _suppress_group(ttl_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        batch = pd.concat(list(pdfs)).sort_values(["ts_us", "event_id"])
        hit, lookup = [], []
        for ts, cookies, force in zip(batch["ts_us"].tolist(), batch["cookies"].tolist(), batch["force_refresh"].tolist()):
            asks = not cookies and not force
            served = asks and last is not None and ts - last < ttl_us
            if not cookies and not served:
                last = ts                         # a miss or a forced refresh writes
            lookup.append(asks)
            hit.append(served)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + ttl_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"event_id": batch["event_id"].values, "ts": batch["ts"].values, "cache_key": key[0],
                            "cache_hit": hit, "cache_lookup": lookup})
    return fn


def suppress_repeats_stream(requests: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """S5 on a stream of validated requests (see ``requests.validated_requests``);
    requests later than ``delay`` behind the watermark are dropped."""
    ts = F.col("ts").cast("timestamp")
    v = requests.where("ok").select("event_id", ts.alias("ts"), "cache_key", F.coalesce("force_refresh", F.lit(False)).alias("force_refresh"),
                                    F.col("cookie_count").isNotNull().alias("cookies"), F.unix_micros(ts).alias("ts_us"))
    return v.withWatermark("ts", delay).groupBy("cache_key").applyInPandasWithState(
        _suppress_group(ttl_seconds * 1_000_000), SUPPRESS_OUT, SUPPRESS_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------ T1 / T2 -------
SMOOTH_OUT = T.StructType([
    T.StructField("scan_id", T.LongType()), T.StructField("domain", T.StringType()),
    T.StructField("raw_score", T.LongType()), T.StructField("smoothed_score", T.LongType()),
    T.StructField("history_depth", T.LongType())])
SMOOTH_STATE = T.StructType([T.StructField("history", T.StringType())])
# Domains share this many state groups: a group costs milliseconds however few rows
# it gets, so there must not be one for each of millions of domains.
SMOOTH_GROUPS = 1 << 14


def _smooth_group(window: int, decay: float):
    powers = [decay ** i for i in range(window)]

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        histories = {d: h for d, h in json.loads(state.get[0])} if state.exists else {}
        batch = pd.concat(list(pdfs))
        batch = batch.iloc[np.lexsort((batch["scan_id"].to_numpy(), batch["scan_ts"].to_numpy()))]
        domains = [None if pd.isna(d) else d for d in batch["domain"].tolist()]
        out_s, out_d = [], []
        for d, s in zip(domains, batch["raw_score"].astype("int64").tolist()):
            hist = histories.get(d, [])
            out_d.append(len(hist))
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
            out_s.append(sm)
            histories[d] = (hist + [sm])[-window:]
        state.update((json.dumps(list(histories.items())),))
        yield pd.DataFrame({"scan_id": batch["scan_id"].astype("int64").values, "domain": domains,
                            "raw_score": batch["raw_score"].astype("int64").values,
                            "smoothed_score": out_s, "history_depth": out_d})
    return fn


def smoothing_stream(scans: DataFrame, window: int = fixed.TEMPORAL_WINDOW,
                     decay: float = fixed.TEMPORAL_DECAY, groups: int = SMOOTH_GROUPS) -> DataFrame:
    """T1/T2 on a stream of (scan_id, domain, scan_ts, raw_score)."""
    return scans.withColumn("_group", F.pmod(F.xxhash64("domain"), F.lit(groups))).groupBy("_group").applyInPandasWithState(
        _smooth_group(window, decay), SMOOTH_OUT, SMOOTH_STATE, "append", GroupStateTimeout.NoTimeout)


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append") -> str:
    """Drain the stream once into a parquet table in the shared checkpoint
    dir; returns the table path."""
    spark = stream.sparkSession
    run = f"{name}-{uuid.uuid4().hex}"
    out = scratch_path(spark, run + "/data")
    q = (stream.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", scratch_path(spark, run + "/checkpoint"))
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return out


# ------------------------------------------------------------------ S19 -----
def append_reports(batch: DataFrame, epoch_id: int, path: str) -> None:
    """foreachBatch sink: append the batch with its epoch as write order."""
    batch.withColumn("_epoch", F.lit(epoch_id).cast("bigint")).write.mode("append").parquet(path)


def latest_reports(spark: SparkSession, path: str, key: str = "scan_id",
                   order=("_epoch", "write_ts", "event_id")) -> DataFrame:
    """Last write wins per key: one pre-aggregated max_by per key."""
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in order if c in df.columns]))
    return df.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def report_sink_stream(stream: DataFrame, path: str, checkpoint: str):
    return (stream.writeStream.foreachBatch(lambda b, e: append_reports(b, e, path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
