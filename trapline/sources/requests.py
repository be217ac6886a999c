"""S2–S5 — scan-request ingestion: validation, URL sanitising, cache keys and
repeat-scan suppression, as columns of one bulk job over a request table.

Validation is one ordered CASE chain (first failing rule wins).  Repeat
suppression is a per-key recurrence (the TTL runs from the last *write*), so
it runs as a sorted streaming fold with O(1) state per key, like the trust
smoothing; requests of one key never have to fit in one array or group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.session import materialize
from trapline.functions.columns import py_strip
from trapline.sources.tables import read_table

# FIXED VALUES — request limits and messages.
MAX_URL_LENGTH = 2048
MAX_COOKIES = 100
MAX_FIELD_CHARS = MAX_URL_LENGTH * 10
PSEUDO_SCHEMES = ["javascript:", "vbscript:", "data:", "blob:"]
URL_RE = r"(?i)^https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+$"
CACHE_TTL_SECONDS = 300
ERR_REQUIRED = "Field 'url' is required."
ERR_LENGTH = f"URL exceeds maximum length of {MAX_URL_LENGTH} characters."
ERR_FORMAT = "Invalid URL format. Must be a valid http/https URL."
ERR_HOST = "URL must include a valid hostname."
ERR_COOKIES = f"Too many cookies (max {MAX_COOKIES})."
ERR_FIELD = "Field 'url' exceeds maximum allowed size."


def sanitize(url: Column) -> Column:
    """S3: strip and prepend https:// when no http(s) scheme."""
    u = py_strip(url)
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def cache_key(url: Column) -> Column:
    """Lower → strip → rstrip('/') → sha256 → first 32 hex chars."""
    norm = F.regexp_replace(py_strip(F.lower(url)), "/+$", "")
    return F.substring(F.sha2(norm, 256), 1, 32)


def validate(url: Column, cookie_count: Column | None = None,
             stripped: Column | None = None) -> tuple[Column, Column, Column]:
    """(ok, error, clean_url) with the rules in their order.  Pass the
    already-stripped url as ``stripped`` to evaluate the strip once."""
    u = py_strip(F.coalesce(url, F.lit(""))) if stripped is None else stripped
    scheme = F.lower(F.substring_index(u, "://", 1))
    low = F.lower(u)
    pseudo = None
    for p in PSEUDO_SCHEMES:
        c = F.when(low.startswith(p), F.lit(f"Scheme '{p}' is not allowed. Only http and https are supported."))
        pseudo = c if pseudo is None else F.coalesce(pseudo, c)
    clean = sanitize(u)
    err = (F.when(url.isNull() | (url == ""), ERR_REQUIRED)
           .when(F.length(u) > MAX_URL_LENGTH, ERR_LENGTH)
           .when(u.contains("://") & ~scheme.isin("http", "https"),
                 F.concat(F.lit("Scheme '"), scheme, F.lit("://' is not allowed. Only http and https are supported.")))
           .when(pseudo.isNotNull(), pseudo)
           .when(~clean.rlike(URL_RE), ERR_FORMAT)
           .when(netloc(clean) == "", ERR_HOST))
    if cookie_count is not None:
        err = err.when(cookie_count > MAX_COOKIES, ERR_COOKIES)
    err = err.when(F.length(url) > MAX_FIELD_CHARS, ERR_FIELD)
    return err.isNull(), err, F.when(err.isNull(), clean)


def request_overlay(spark, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Overlay C: scan requests derived from events (url mix incl. bad
    schemes, pseudo schemes, missing scheme, invalid characters and nulls;
    'signup' carries cookies, 'error' forces a refresh).  ``events`` may be the
    same table as a stream."""
    ev = read_table(spark, sf_dir, "events") if events is None else events
    host = F.concat(F.lit("Host"), (F.col("user_id") % 8).cast("string"), F.lit(".example.com/p"),
                    (F.col("event_id") % 3).cast("string"),
                    F.when(F.col("event_id") % 2 == 0, F.lit("/")).otherwise(F.lit("")))
    eid = F.col("event_id")
    url = (F.when(eid % 13 == 0, F.lit(None).cast("string"))
           .when(eid % 11 == 0, F.concat(F.lit("ftp://"), host))
           .when(eid % 17 == 0, F.lit("javascript:void(0)"))
           .when(eid % 19 == 0, F.concat(F.lit("  "), host))
           .when(eid % 23 == 0, F.concat(F.lit("https://"), host, F.lit(" x")))
           .otherwise(F.concat(F.lit("https://"), host)))
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select("event_id", "ts", url.alias("url"),
                     F.when(F.col("event_type") == "signup", k + 1).alias("cookie_count"),
                     (F.col("event_type") == "error").alias("force_refresh"))


def validated_requests(req: DataFrame) -> DataFrame:
    s = req.select("*", py_strip(F.coalesce(F.col("url"), F.lit(""))).alias("_u"))
    s = s.select("*", sanitize(F.col("_u")).alias("_clean"),
                 F.lower(F.substring_index(F.col("_u"), "://", 1)).alias("_scheme"))
    _, err, _ = validate(F.col("url"), F.col("cookie_count"), F.col("_u"))
    # the rule chain is evaluated once; everything else derives from it
    v = s.select("*", err.alias("error"))
    ok = F.col("error").isNull()
    return v.select(*req.columns, ok.alias("ok"), "error", F.when(ok, F.col("_clean")).alias("clean_url"),
                    F.when(ok, cache_key(F.col("_clean"))).alias("cache_key"))


def _ttl_fold(ttl_us: int):
    def fold(batches):
        cur, last_write = None, None
        for pdf in batches:
            keys = pdf["_segment"].to_numpy()
            ts = pdf["_ts_us"].to_numpy()
            cookies = pdf["_cookies"].to_numpy()
            force = pdf["force_refresh"].to_numpy()
            hit = np.zeros(len(pdf), dtype=bool)
            lookup = np.zeros(len(pdf), dtype=bool)
            for i in range(len(pdf)):
                if keys[i] != cur:
                    cur, last_write = keys[i], None
                if cookies[i]:
                    continue                      # neither reads nor writes
                if not force[i]:
                    lookup[i] = True
                    if last_write is not None and ts[i] - last_write < ttl_us:
                        hit[i] = True
                        continue                  # served from cache, no write
                last_write = ts[i]                # miss or forced refresh writes
            yield pdf.assign(cache_hit=hit, cache_lookup=lookup).drop(columns=["_ts_us", "_cookies", "_segment"])
    return fold


def with_segments(v: DataFrame, ttl_us: int) -> DataFrame:
    """``_segment`` of each request: a name shared by requests of one key whose fate
    does not depend on any request outside.  A segment starts at a request that
    writes whatever came before: a forced refresh, or one that follows the last
    request without cookies after the TTL or more.

    The gap is found in slots of one TTL: within a slot by a window over (key,
    slot), across slots by the last request of the slot before, since anything
    older lies a TTL back.  So no window holds a key's whole history but the one
    over its slot summaries."""
    slot = v.withColumn("_active", ~F.col("_cookies")).withColumn("_slot", F.floor(F.col("_ts_us") / F.lit(ttl_us)))
    own = Window.partitionBy("cache_key", "_slot").orderBy("_ts_us", "event_id")
    before = F.max(F.when(F.col("_active"), F.col("_ts_us"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    last = slot.where("_active").groupBy("cache_key", (F.col("_slot") + 1).alias("_slot")).agg(F.max("_ts_us").alias("_last"))
    slot = slot.withColumn("_before", before).join(last, ["cache_key", "_slot"], "left")
    gap = F.col("_ts_us") - F.coalesce("_before", "_last")
    mark = F.struct("_ts_us", "event_id")
    starts = F.when(F.col("_active") & (F.coalesce("force_refresh", F.lit(False)) | gap.isNull() | (gap >= ttl_us)), mark)
    slot = slot.withColumn("_mark", F.max(starts).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ends = slot.groupBy("cache_key", "_slot").agg(F.max("_mark").alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy("cache_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    slot = slot.join(ends.select("cache_key", "_slot", carried.alias("_carried")), ["cache_key", "_slot"])
    mark = F.coalesce("_mark", "_carried")
    return slot.select(*v.columns, F.concat_ws(" ", "cache_key", mark["_ts_us"].cast("string"), mark["event_id"].cast("string")).alias("_segment"))


def suppress_repeats(valid: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS,
                     num_partitions: int | None = None) -> DataFrame:
    """S5 (batch): flag requests served from the result cache.  Rows are
    hash-partitioned by segment (see ``with_segments``), so a hot key's history
    is folded in as many tasks as it has segments, and sorted by (ts, event_id)."""
    v = valid.where(F.col("ok")).select(
        "event_id", "ts", "cache_key", "force_refresh",
        F.col("cookie_count").isNotNull().alias("_cookies"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_ts_us"))
    ttl_us = ttl_seconds * 1_000_000
    seg = with_segments(materialize(v, "requests"), ttl_us)  # read three times: validated once
    parted = seg.repartition(num_partitions, "_segment") if num_partitions else seg.repartition("_segment")
    parted = parted.sortWithinPartitions("_segment", "ts", "event_id")
    schema = T.StructType([f for f in v.schema.fields if f.name not in ("_ts_us", "_cookies")]
                          + [T.StructField("cache_hit", T.BooleanType()), T.StructField("cache_lookup", T.BooleanType())])
    return parted.mapInPandas(_ttl_fold(ttl_us), schema)


def cache_stats(flags: DataFrame) -> DataFrame:
    """Hit / miss counts over cache lookups and the hit rate (3 dp)."""
    hits = F.count_if(F.col("cache_hit")).cast("bigint")
    looks = F.count_if(F.col("cache_lookup")).cast("bigint")
    return flags.agg(hits.alias("hits"), (looks - hits).alias("misses"),
                     F.when(looks > 0, F.round(hits / looks, 3)).otherwise(F.lit(0.0)).alias("hit_rate"),
                     F.countDistinct("cache_key").cast("bigint").alias("keys"))
