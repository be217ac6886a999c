"""Quality rules: tokeniser fertility.

Two public vocabularies read every word of a text (a leading space marks it):
byte-level BPE gives characters per token; BPE with byte fallback gives
characters per token, the share of fallback bytes and the entropy of its tokens,
as a share of the greatest that many tokens can have.  Text that is not prose of
its language breaks into more or fewer pieces, falls back to bytes or repeats
its tokens.  A document is rejected when a measure leaves the band of its
language: median -+ ``spread`` robust deviations (1.4826 x MAD, at least
``floor`` times the median).  Bands come from all documents of the language; a
language with under ``least`` documents that pass the base rules has no band, and
its documents are judged by the base rules alone: the band of its script is that
of the dominant language, which clean prose of another need not meet.  ``least``
is a fixed count, so a language does not lose its band as others grow.

Simple counts of words, symbols, repeated lines and repeated three-word windows
come with the measures; too few words or too much repetition fails a document
before the bands are asked.

Each piece of a batch tokenises its distinct words only; one narrow pass reads
the texts, and the bands come from a written table of measures.

Cases: null text has no words (and fails the base rule); null language is a
language of its own name "", without a band if rare; repeated rows are judged
alike; an empty table gives an empty result; extra columns are ignored by
``judge`` and kept by ``accepted``."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.llm import common as C
from trapline.session import materialize

MIN_WORDS, MAX_REPEAT = 50, 50
SPREAD, FLOOR, LEAST = 6.0, 0.05, 100
KNOWN_WORDS = 100_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCRIPTS = ["other", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "east asian"]
# script of a UTF-8 lead byte
LEAD = np.zeros(256, np.int64)
for _lo, _hi, _k in ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xC9, 1), (0xCD, 0xCF, 2), (0xD0, 0xD4, 3), (0xD6, 0xD7, 4),
                     (0xD8, 0xDD, 5), (0xE0, 0xE0, 6), (0xE3, 0xED, 7)):
    LEAD[_lo:_hi + 1] = _k

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "byte_tokens", "piece_tokens"]
MEASURES = ["byte_chars_per_token", "piece_chars_per_token", "fallback_share", "token_entropy"]


@lru_cache(2)
def vocabularies(byte_path: str, piece_path: str, pattern: str):
    import base64

    import sentencepiece
    import tiktoken
    with open(byte_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    fallback = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sp, fallback, {}


def counts(data, offs):
    """Words of each text, and the plain counts."""
    n = len(offs) - 1
    s, e, wo = C.words(data, offs)
    h = C.word_hashes(data, s, e)
    nw = np.diff(wo)
    doc = np.repeat(np.arange(n), nw)
    per_doc = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offs])  # noqa: E731  by byte
    chars = per_doc(((data & 0xC0) != 0x80) & ~C.SEP[data])
    symbols = per_doc(SYMBOLS[data])
    # lines
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    cut[1:][data == 0x0A] = True
    begin = np.flatnonzero(cut[:-1]) if len(data) else np.empty(0, np.int64)
    stop = np.r_[begin[1:], len(data)][:len(begin)]
    stop = stop - ((data[np.maximum(stop, 1) - 1] == 0x0A) & (stop > begin)) if len(begin) else stop
    has = np.searchsorted(s, stop) > np.searchsorted(s, begin)
    begin, stop = begin[has], stop[has]
    line = C.span_hash(C.prefix(C.BYTE[data]), begin, stop)
    of = np.searchsorted(offs, begin, "right") - 1
    dup = np.zeros(n, np.int64)
    if len(line):
        order = np.lexsort((line, of))
        again = (line[order][1:] == line[order][:-1]) & (of[order][1:] == of[order][:-1])
        dup = np.bincount(of[order][1:][again], minlength=n)
    # three-word windows
    repeat = np.zeros(n, np.int64)
    if len(h) >= 3:
        sums = C.prefix(h)
        g = C.roll_hash(sums, 3)
        i = np.flatnonzero(doc[2:] == doc[:-2])
        order = i[np.lexsort((g[i], doc[i]))]
        same = (g[order][1:] == g[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        hit = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[hit + k] = True
        repeat = np.bincount(doc[covered], minlength=n)
    return s, e, h, doc, nw, chars, symbols, dup, repeat


def _fertility(data, s, e, h, doc, n, vocab):
    """Per document: byte-level tokens, fallback-BPE tokens, fallback bytes, entropy share."""
    enc, sp, fallback, known = vocab
    u, first, inv = np.unique(h, return_index=True, return_inverse=True)
    keys, raw = u.tolist(), data.tobytes()
    new = [k for k, x in enumerate(keys) if x not in known]
    if new:
        if len(known) > KNOWN_WORDS:
            known.clear()
            new = list(range(len(keys)))
        text = [raw[a:b].decode() for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist())]
        bpe = [enc.encode_ordinary(" " + t) for t in text]
        for k, t, b, p in zip(new, text, bpe, sp.encode(text, num_threads=1)):
            known[keys[k]] = (len(b), np.array(p, np.int32).tobytes())
    got = [known[x] for x in keys]
    nb = np.array([x[0] for x in got], np.int64)
    flat = np.frombuffer(b"".join([x[1] for x in got]), np.int32)
    size = np.array([len(x[1]) // 4 for x in got], np.int64)
    at = np.cumsum(size) - size
    byte_tokens = np.bincount(doc, nb[inv], n).astype(np.int64)
    pair, mult = np.unique(doc * np.int64(len(u)) + inv, return_counts=True)
    d, w = pair // len(u), pair % len(u)
    m = size[w]
    i = np.repeat(at[w] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    tok, td, tc = flat[i], np.repeat(d, m), np.repeat(mult, m)
    total = np.bincount(td, tc, n)
    spill = np.bincount(td, tc * fallback[tok], n)
    cell, inv2 = np.unique(td * np.int64(1 << 20) + tok, return_inverse=True)
    c = np.bincount(inv2, tc)
    cd = cell >> 20
    share = c / total[cd]
    entropy = np.bincount(cd, -share * np.log2(share), n)
    return byte_tokens, total.astype(np.int64), spill, entropy / np.log2(np.maximum(total, 2))


def _measure(paths, carried: bool):
    def rows(batches):
        vocab = vocabularies(*paths)
        for batch in batches:
            for part, data, offs in C.pieces(batch, "text"):
                n = part.num_rows
                s, e, h, doc, nw, chars, symbols, dup, repeat = counts(data, offs)
                zero = np.zeros(n)
                bt, pt, spill, entropy = _fertility(data, s, e, h, doc, n, vocab) if len(h) else (zero.astype(np.int64),) * 2 + (zero, zero)
                lead = np.bincount(np.repeat(np.arange(n), np.diff(offs)) * len(SCRIPTS) + LEAD[data], minlength=n * len(SCRIPTS))
                script = lead.reshape(n, -1)[:, 1:].argmax(1) + 1
                script = np.where(lead.reshape(n, -1)[:, 1:].sum(1) == 0, 0, script)
                per = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
                columns = [nw, chars, symbols, dup, repeat, bt, pt, per(chars, bt), per(chars, pt), per(spill, pt), entropy,
                           pa.array([SCRIPTS[k] for k in script], pa.string())]
                names = COUNTS + MEASURES + ["script"]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                own = ["row", "text", "lang"] if carried else ["row", "lang"]
                yield pa.RecordBatch.from_arrays([*map(part.column, own), *arrays], [*own, *names])
    return rows


def default_vocabularies() -> tuple[str, str, str]:
    import public_tokenizers as P
    return P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.PATTERN


def _judged(docs: DataFrame, row, paths, text, lang, spread, floor, least, carried=False) -> DataFrame:
    """row (as given), text (if carried), lang, counts, measures, script, base_failed, kept, failed
    (the measures out of band)."""
    # a null text comes as an empty one: its offsets in the Arrow batch are equal
    source = C.bounded_batches(docs).select(row.alias("row"), F.col(text).cast("string").alias("text"),
                         F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    out = T.StructType([source.schema["row"], *([source.schema["text"]] if carried else []), T.StructField("lang", T.StringType()),
                        *[T.StructField(c, T.LongType()) for c in COUNTS], *[T.StructField(c, T.DoubleType()) for c in MEASURES],
                        T.StructField("script", T.StringType())])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    table = materialize(source.mapInArrow(_measure(paths or default_vocabularies(), carried), out).withColumn("base_failed", base), "fertility")

    def bands(by: str) -> DataFrame:
        sound = table.where(~F.col("base_failed")).select(by, *MEASURES)
        mid = sound.groupBy(by).agg(F.count("*").alias("docs"), *[F.percentile_approx(m, 0.5, 10000).alias(f"mid_{m}") for m in MEASURES])
        mid = materialize(mid.where(F.col("docs") >= least), "mids")  # as many as languages: written, so their size is known to the joins
        off = sound.join(mid, by).groupBy(by).agg(*[F.percentile_approx(F.abs(F.col(m) - F.col(f"mid_{m}")), 0.5, 10000).alias(f"off_{m}") for m in MEASURES])
        return mid.join(off, by).select(by, F.struct(*[F.struct(
            F.col(f"mid_{m}").alias("mid"), F.greatest(1.4826 * F.col(f"off_{m}"), floor * F.abs(F.col(f"mid_{m}")), F.lit(0.002)).alias("dev")).alias(m)
            for m in MEASURES]).alias(f"band_{by}"))
    full = table.join(materialize(bands("lang"), "bands"), "lang", "left")
    band = F.col("band_lang")
    # fallback bytes are judged upwards only, entropy downwards only
    low = {m: F.col(m) < band[m]["mid"] - spread * band[m]["dev"] for m in MEASURES if m != "fallback_share"}
    high = {m: F.col(m) > band[m]["mid"] + spread * band[m]["dev"] for m in MEASURES if m != "token_entropy"}
    failed = F.array_compact(F.array(*[F.when(F.coalesce(low.get(m, F.lit(False)) | high.get(m, F.lit(False)), F.lit(False)), F.lit(m)) for m in MEASURES]))
    return (full.withColumn("failed", failed).drop("band_lang")
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)))


def judge(docs: DataFrame, paths=None, text="text", lang="lang", doc_id="doc_id", spread=SPREAD, floor=FLOOR, least=LEAST) -> DataFrame:
    """One row per document: doc_id, counts, measures, script, base_failed, kept, failed."""
    return (_judged(docs, F.struct(F.col(doc_id).cast("long").alias("doc_id")), paths, text, lang, spread, floor, least)
            .select("row.doc_id", *COUNTS, *MEASURES, "script", "base_failed", "kept", "failed"))


def accepted(docs: DataFrame, paths=None, text="text", lang="lang", spread=SPREAD, floor=FLOOR, least=LEAST) -> DataFrame:
    """The documents that are kept, with their columns."""
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != text])
    out = _judged(docs, row, paths, text, lang, spread, floor, least, carried=True).where("kept")
    return out.select(*[F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op1(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
