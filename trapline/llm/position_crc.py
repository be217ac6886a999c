"""Target-distribution importance resampling over hashed word features.

Features are runs of 1 to ``max_words`` consecutive words, joined by one space;
a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.  CRC-32 is
linear over XOR, so a feature's value is the XOR of one contribution per byte,
which depends only on the byte and its distance from the feature's end, and of a
constant that depends only on the length.  A table (distance x byte) gives the
contributions of a whole batch at once; ``bitwise_xor.reduceat`` over the feature
spans adds them up.  A span longer than the table is cut into blocks from its end;
block values are folded pairwise with the operator "as many zero bytes more",
whose powers of two are kept, and the same powers give its length constant.

Documents are counted against a target: a bucket's gain is
floor(1000 ln(share in target / share in documents)), each share smoothed by one;
a document's weight is the sum of its features' gains.  Gumbel noise from a hash of
its id turns "the highest scores" into a draw without replacement in proportion to
the weights.  Two passes read the texts; between them stand ``buckets`` counts a
side, a number that does not grow with the documents.  Ranks are global: rows are
dealt by score ranges, numbered within each range and offset by the counts of the
ranges before, so no task holds more than a range.

Cases: null and empty texts have no features and weight 0; a null doc_id is hashed
as the empty text and comes last among ties; repeated rows are documents of their
own; an empty target or table leaves gains and draws well defined (nothing drawn
from nothing); columns other than the two named are ignored."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm import common as C
from trapline.session import materialize

BUCKETS, MAX_WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
REACH = 64  # distances in the table; a power of two
POLYNOMIAL = 0xEDB88320  # CRC-32, reflected
_ONES = np.uint32(0xFFFFFFFF)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ np.where(c & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return c


def apply(op: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A linear operator, kept as what it makes of each of a value's four bytes."""
    return op[0][v & 255] ^ op[1][v >> 8 & 255] ^ op[2][v >> 16 & 255] ^ op[3][v >> 24]


class PositionTables:
    """Contributions by distance from the end, length constants, and the
    operators for 2^k more zero bytes."""

    def __init__(self):
        table = _byte_table()
        more = lambda c: table[c & 255] ^ (c >> 8)  # noqa: E731  one zero byte
        self.contribution = np.empty((REACH, 256), np.uint32)
        self.contribution[0] = table
        for d in range(1, REACH):
            self.contribution[d] = more(self.contribution[d - 1])
        self.constant = np.empty(REACH + 1, np.uint32)
        self.constant[0] = _ONES
        for n in range(1, REACH + 1):
            self.constant[n] = more(self.constant[n - 1:n])[0]
        self.constant ^= _ONES
        bytes_ = np.arange(256, dtype=np.uint32)
        self.zeros = [np.stack([more(bytes_ << np.uint32(8 * k)) for k in range(4)])]

    def power(self, k: int) -> np.ndarray:
        while len(self.zeros) <= k:
            last = self.zeros[-1]
            self.zeros.append(apply(last, last))
        return self.zeros[k]

    def constants(self, length: np.ndarray) -> np.ndarray:
        out = self.constant[np.minimum(length, REACH)]
        far = np.flatnonzero(length > REACH)
        if len(far):
            c, n = np.full(len(far), _ONES), length[far]
            for k in range(int(n.max()).bit_length()):
                c = np.where(n >> k & 1, apply(self.power(k), c), c)
            out[far] = c ^ _ONES
        return out

    def crc32(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of each non-empty span data[start:end]."""
        if not len(start):
            return np.empty(0, np.uint32)
        length = end - start
        blocks = (length + REACH - 1) // REACH
        span = np.repeat(np.arange(len(start)), blocks)
        back = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(span))  # blocks after this one in its span
        b_end = end[span] - back * REACH
        b_start = np.maximum(b_end - REACH, start[span])
        size = b_end - b_start
        first = np.cumsum(size) - size
        places = C.ragged(b_start, size)
        distance = np.repeat(b_end, size) - 1 - places
        value = np.bitwise_xor.reduceat(self.contribution[distance, data[places]], first)
        k = REACH.bit_length() - 1
        while len(value) > len(start):
            odd = np.flatnonzero(back & 1)
            value[odd] = apply(self.power(k), value[odd])
            back = back >> 1
            head = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (back[1:] != back[:-1])])
            value, span, back = np.bitwise_xor.reduceat(value, head), span[head], back[head]
            k += 1
        return value ^ self.constants(length)


@lru_cache(1)
def tables() -> PositionTables:
    return PositionTables()


def features(data: np.ndarray, offs: np.ndarray, buckets: int, max_words: int):
    """Words of each text, and for each feature its text's number and its bucket."""
    data = LOWER[data]
    inside = WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:len(data)]
    end[:-1] &= ~inside[1:] | first[1:len(data)]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    text = np.searchsorted(offs, s, "right") - 1
    n_words = np.bincount(text, minlength=len(offs) - 1)
    line, at = C.joined(data, s, e)
    docs, hashes = [], []
    for k in range(max_words):
        i = np.flatnonzero(text[:len(text) - k] == text[k:]) if k else np.arange(len(text))
        docs.append(text[i])
        hashes.append(tables().crc32(line, at[i], at[i + k + 1] - 1) % np.uint32(buckets))
    return n_words, np.concatenate(docs), np.concatenate(hashes).astype(np.int64)


def _texts(docs: DataFrame, text: str, doc_id: str | None = None) -> DataFrame:
    cols = [F.col(doc_id).cast("long").alias("doc_id")] if doc_id else []
    return C.bounded_batches(docs).select(*cols, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> np.ndarray:
    """Features of all texts by bucket; each task sends one row a bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def rows(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offs in C.pieces(batch, "text"):
                total += np.bincount(features(data, offs, buckets, max_words)[2], minlength=buckets)
        yield C.record(schema, np.flatnonzero(total), total[total > 0])

    counted = _texts(docs, text).mapInArrow(rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln(...)) of each bucket's smoothed share in the target over that in the documents."""
    n, s, t = len(have), have.astype(float), want.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
             buckets: int = BUCKETS, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    gain = gains(bucket_counts(docs, text, buckets, max_words), bucket_counts(target, target_text, buckets, max_words))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def rows(batches):
        for batch in batches:
            for part, data, offs in C.pieces(batch, "text"):
                n_words, doc, bucket = features(data, offs, buckets, max_words)
                weight = np.zeros(part.num_rows, np.int64)
                np.add.at(weight, doc, gain[bucket])
                yield C.record(schema, part.column("doc_id"), n_words, np.bincount(doc, minlength=part.num_rows), weight)

    return _texts(docs, text, doc_id).mapInArrow(rows, "doc_id long, n_words long, n_features long, weight long")


def drawn(weights: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """``weights`` with score and rank; rank numbers the floor(percent N / 100)
    highest scores of the N documents with ``min_words`` words, others have none."""
    spark = weights.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weights.withColumn("score", F.col("weight") + noise).withColumn("short", F.col("n_words") < min_words), "scores")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(scored.repartitionByRange(n, F.col("short"), *order).withColumn("range", F.spark_partition_id()), "score_ranges")
    # one count a range: as many rows as there are partitions
    sizes = sorted((r["range"], r["n"]) for r in dealt.where("not short").groupBy("range").agg(F.count("*").alias("n")).collect())
    take, before, offsets = percent * sum(c for _, c in sizes) // 100, 0, []
    for k, c in sizes:
        offsets.append((k, before))
        before += c
    offsets = spark.createDataFrame(offsets, "range int, before long")
    place = F.row_number().over(Window.partitionBy("range", "short").orderBy(*order)) + F.col("before")
    numbered = dealt.join(F.broadcast(offsets), "range", "left").withColumn("place", F.when(~F.col("short"), place).cast("long"))
    return numbered.withColumn("rank", F.when(F.col("place") <= take, F.col("place"))).drop("place", "before", "range", "short")


def resampled(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
              percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, **how) -> DataFrame:
    """The drawn documents with all their columns; rows that share a drawn id come together."""
    ranks = drawn(weighted(docs, target, text, doc_id, target_text, **how), percent, min_words, seed).where("rank is not null")
    chosen = ranks.select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(chosen, F.col(doc_id).cast("long").eqNullSafe(F.col("drawn_id")), "left_semi")


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return drawn(weighted(docs, bench)).select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """Bytes one by one through a CRC table that SQL builds."""
    upper = "".join(map(chr, range(0x41, 0x5B)))
    words = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: xor(c >> 1, (c & 1) * {POLYNOMIAL}))) AS tab),
d AS (SELECT doc_id, unnest({words}) AS w FROM documents),
b AS (SELECT unnest({words}) AS w FROM benchmark),
word AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM d UNION SELECT w FROM b)),
bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % {BUCKETS} AS k
  FROM word, crc),
s AS (SELECT k, count(*) AS n FROM d JOIN bucket USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM b JOIN bucket USING (w) GROUP BY k),
gain AS (
  SELECT s.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
    / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS g
  FROM s LEFT JOIN t USING (k)),
weight AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM d JOIN bucket USING (w) JOIN gain USING (k) GROUP BY doc_id),
scored AS (
  SELECT o.doc_id, coalesce(w.n, 0)::BIGINT AS n_features, coalesce(w.weight, 0)::BIGINT AS weight,
    (coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || o.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents o LEFT JOIN weight w USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id::BIGINT AS doc_id, n_features, weight, score,
  CASE WHEN n_features >= {MIN_WORDS} AND place <= {PERCENT} * (SELECT count(*) FROM scored WHERE n_features >= {MIN_WORDS}) // 100 THEN place END::BIGINT AS rank
FROM placed"""
