"""Quality classifier: an interpolated modified Kneser-Ney trigram model.

It is trained on trusted text: documents labelled good and not toxic.  Of these
``sample`` documents (a documented bound, the least by hash) train the model.
Spark counts their trigrams, sharded by hash, and joins the count shards:
continuation counts come from counting distinct left words, discounts D1, D2 and
D3+ from the counts of counts, and each n-gram's count meets its context's total
in a join.  N-grams seen ``LEAST`` times or more enter the model's tables; what
the others would get goes to the lower order, so every context still sums to
one.  The tables are bounded by the sample; they go to all tasks in ``SHARDS``
sorted shards, and each document's n-grams are joined to the shards where the
document lies, which needs no shuffle of texts.

Perplexity is held against a quantile of its language: of trusted documents that
did not train the model, times ``slack``; a language without any takes the
quantile of all.  Documents above it are rejected.

Cases: null text has no tokens, perplexity null, and is rejected; null language
is ""; a label of a missing document is ignored, several labels of one document
count as trusted only if all are; null ids are never trusted; without trusted
documents nothing but texts without words is rejected; rows repeated whole are
judged alike; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import common as C
from trapline.session import materialize

SAMPLE, QUANTILE, SLACK, LEAST, SHARDS = 10_000, 0.99, 1.25, 2, 16
START = np.uint64(0x51ED270B0F5C2A17)
END = np.uint64(0xD1B54A32D192ED03)

_GRAM = "u long, v long, w long, c long"
_GRAM_PA = pa.schema([(x, pa.int64()) for x in "uvwc"])


def tokens(data, offs):
    """Words of each text between two starts and one end; and the offsets."""
    s, e, wo = C.words(data, offs)
    h = C.word_hashes(data, s, e)
    n = len(offs) - 1
    at = wo + 3 * np.arange(n + 1)
    out = np.full(len(h) + 3 * n, START, np.uint64)
    own = np.ones(len(out), bool)
    for k in (at[:-1], at[:-1] + 1, at[1:] - 1):
        own[k] = False
    out[at[1:] - 1] = END
    out[own] = h
    return out, at


def _places(at):
    """Places of the tokens to predict (all but the starts), and their document."""
    n = np.diff(at) - 2
    doc = np.repeat(np.arange(len(n)), n)
    return at[:-1][doc] + 2 + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n), doc


def _trigrams(batches):
    for batch in batches:
        for _, data, offs in C.pieces(batch, "text"):
            tok, at = tokens(data, offs)
            i, _ = _places(at)
            tok = C.as_long(tok)
            order = np.lexsort((tok[i], tok[i - 1], tok[i - 2]))
            i = i[order]
            g = np.stack([tok[i - 2], tok[i - 1], tok[i]])
            new = np.flatnonzero(np.r_[True, (g[:, 1:] != g[:, :-1]).any(axis=0)])
            yield C.record(_GRAM_PA, *g[:, new], np.diff(np.append(new, len(i))))


def key2(v, w):
    return C.mix(C.mix(v) + w)


def key3(u, v, w):
    return C.mix(C.mix(C.mix(u) + v) + w)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney, held to [0, count]."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0)
    return tuple(min(max(d, 0.0), k + 1.0) for k, d in enumerate(raw))


def _order(counts: DataFrame, context: list[str], least: int):
    """(n-grams with their share, contexts with what is left) of one order."""
    n = counts.agg(*[F.coalesce(F.sum((F.col("c") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    d1, d2, d3 = discounts(*n)
    off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
    if context:
        total = counts.groupBy(*context).agg(F.sum("c").alias("total"))
        shares = counts.where(F.col("c") >= least).join(total, context)
    else:
        shares = counts.crossJoin(counts.agg(F.sum("c").alias("total")))  # one row
    shares = shares.select(*[c for c in counts.columns if c != "c"], ((F.col("c") - off) / F.col("total")).alias("p"))
    return shares, (shares.groupBy(*context) if context else shares).agg((1 - F.sum("p")).alias("left"))


class Shards:
    """A sorted key -> value table in parts by the key's last bits."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        part = key % np.uint64(SHARDS)
        self.keys, self.values = [], []
        for k in range(SHARDS):
            m = part == k
            order = np.argsort(key[m])
            self.keys.append(key[m][order])
            self.values.append(value[m][order])

    def get(self, x: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(x), missing)
        part = x % np.uint64(SHARDS)
        for k in range(SHARDS):
            keys = self.keys[k]
            if len(keys):
                i = np.flatnonzero(part == k)
                j = np.minimum(np.searchsorted(keys, x[i]), len(keys) - 1)
                hit = keys[j] == x[i]
                out[i[hit]] = self.values[k][j[hit]]
        return out


def _columns(df: DataFrame, *names):
    t = df.toArrow()
    return [t.column(c).to_numpy().view(np.uint64) if t.schema.field(c).type == pa.int64() else t.column(c).to_numpy() for c in names]


def train(texts: DataFrame, least: int = LEAST):
    """The model's tables; ``texts`` must be bounded, as the sample is."""
    c3 = materialize(texts.select("text").mapInArrow(_trigrams, _GRAM).groupBy("u", "v", "w").agg(F.sum("c").alias("c")), "trigrams")
    c2 = materialize(c3.groupBy("v", "w").agg(F.count("*").alias("c")), "bigrams")
    c1 = c2.groupBy("w").agg(F.count("*").alias("c"))
    p3, l3 = _order(c3, ["u", "v"], least)
    p2, l2 = _order(c2, ["v"], least)
    p1, l1 = _order(c1, [], 1)
    u, v, w, p = _columns(p3, "u", "v", "w", "p")
    three = Shards(key3(u, v, w), p)
    u, v, p = _columns(l3, "u", "v", "left")
    left3 = Shards(key2(u, v), p)
    v, w, p = _columns(p2, "v", "w", "p")
    two = Shards(key2(v, w), p)
    v, p = _columns(l2, "v", "left")
    left2 = Shards(C.mix(v), p)
    w, p = _columns(p1, "w", "p")
    rest = l1.first().left
    return three, left3, two, left2, Shards(C.mix(w), p), (1.0 if rest is None else max(rest, 1e-9)) / (len(w) + 1)


def probabilities(model, tok: np.ndarray, i: np.ndarray) -> np.ndarray:
    three, left3, two, left2, one, uniform = model
    u, v, w = tok[i - 2], tok[i - 1], tok[i]
    p = one.get(C.mix(w), 0.0) + uniform
    p = two.get(key2(v, w), 0.0) + left2.get(C.mix(v), 1.0) * p
    return three.get(key3(u, v, w), 0.0) + left3.get(key2(u, v), 1.0) * p


_PPL = "doc_id long, lang string, n_tokens long, log10_prob double, perplexity double"
_PPL_PA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("log10_prob", pa.float64()), ("perplexity", pa.float64())])


def _perplexity(model):
    def rows(batches):
        tables = model.value
        for batch in batches:
            for part, data, offs in C.pieces(batch, "text"):
                tok, at = tokens(data, offs)
                i, doc = _places(at)
                n = np.diff(at) - 2
                total = np.bincount(doc, np.log10(probabilities(tables, tok, i)), len(n))
                ppl = pa.array(10 ** (-total / n), mask=n < 2)
                yield C.record(_PPL_PA, part.column("doc_id"), part.column("lang"), n - 1, total, ppl)
    return rows


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, quantile: float = QUANTILE, slack: float = SLACK,
             least: int = LEAST, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang, n_tokens (words), log10_prob, perplexity, threshold, trained, kept."""
    rows = C.bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    trusted = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good")).where("doc_id is not null")
               .groupBy("doc_id").agg(F.min("good").alias("good")).where("good").select("doc_id"))
    trusted = materialize(trusted.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), "trusted")
    # one trusted document in five trains nothing: the quantiles come from those
    own = materialize(trusted.where(F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) != 0)
                      .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    model = docs.sparkSession.sparkContext.broadcast(train(rows.join(F.broadcast(own), "doc_id"), least))  # at most ``sample`` ids
    scored = materialize(rows.mapInArrow(_perplexity(model), _PPL), "perplexity")
    held = scored.join(trusted.join(own, "doc_id", "left_anti"), "doc_id").where("perplexity is not null")
    cut = lambda name: (F.percentile_approx("perplexity", quantile, 10000) * slack).alias(name)
    by_lang, by_all = held.groupBy("lang").agg(cut("of_lang")), held.agg(cut("of_all"))
    mark = own.withColumn("trained", F.lit(True))
    return (scored.join(by_lang, "lang", "left").crossJoin(by_all).join(mark, "doc_id", "left")  # by_all is one row
            .withColumn("threshold", F.coalesce("of_lang", "of_all"))
            .select("doc_id", "lang", "n_tokens", "log10_prob", "perplexity", "threshold", F.coalesce("trained", F.lit(False)).alias("trained"),
                    (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).alias("kept")))


def op7(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
