"""LM scoring with a weighted backoff automaton.

The model is a trigram model learned from the training documents.  One-word
probabilities are (c + 0.5) / (N + 0.5 (V + 1)) with one class for unknown
words; two- and three-word probabilities are discounted counts, and the mass
left over goes to the shorter context by a backoff weight, so each context's
probabilities sum to one.  Every kept context is a state: arcs carry a word's
log-probability and lead to the longest kept context that ends in that word; the
failure arc carries the backoff weight and leads to the context without its
first word.  A text is scored in one walk from left to right that holds the
state and adds up.

Counts cover all training documents, combined inside each task before the
shuffle.  Every word, and every pair and triple seen ``LEAST`` times or more, is
in the model: the count is fixed, so the model grows with the corpus.  It is
never held in one place: states and arcs are a written table by n-gram hash, with
the arc's log-probability and the backoff weight of the state it enters.

Documents are dealt in blocks of about ``BLOCK`` bytes.  A block asks once for each
distinct n-gram in it, gets the arcs and failure weights by a join, builds the part
of the automaton that its texts can reach and walks every text on it.  Blocks go in
``ROUNDS`` rounds, so that only that share of the answers is on disk at once, and
shuffle files end with the job that wrote them.

The most frequent arcs, ``CACHED`` at most, are broadcast, which keeps hot keys out
of the join; a Bloom filter of fixed size holds back questions for n-grams that are
surely not in the model.  Both change the cost and not the result.

Cases: null text is empty and has the end token only; a null id counts as the
empty text when documents are split; repeated rows are scored alike, each is
learned from; with no training document every token is unknown; an empty table
gives an empty result; extra columns are ignored."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import common as C
from trapline.session import discard, materialize, scratch_tables

CACHED, DISCOUNT, LEAST = 2_000_000, 0.6, 2
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
PAIR_TURN, TRIPLE_TURN = 23, 29
BLOCKS = 1 << 21
FLUSH = 1 << 21
BLOCK, ROUNDS = 2 << 20, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

def tokens(data, offs):
    """Token hashes, each document's words and then its end; and the offsets."""
    data = LOWER[data]
    s, e, wo = C.words(data, offs)
    h = C.word_hashes(data, s, e)
    n = len(offs) - 1
    at = wo + np.arange(n + 1)
    out = np.full(len(h) + n, END, np.uint64)
    own = np.ones(len(out), bool)
    own[at[1:] - 1] = False
    out[own] = h
    return out, at


def joint(a, b, turn):
    """Key of two hashes in order: the first xor the second turned by so many bits
    (others for triples than for pairs, or the word that two pairs share cancels out)."""
    return a ^ (b << np.uint64(turn) | b >> np.uint64(64 - turn))


def joint_column(a: str, b: str, turn: int):
    """The same as a column."""
    return F.col(a).bitwiseXOR(F.shiftleft(b, turn).bitwiseOR(F.shiftrightunsigned(b, 64 - turn)))


def grams(tok, at):
    """For each token: the token before it (``START`` at the start of a text), the
    key of the pair that ends here, whether it is the first, and the keys of the
    pair before and of the triple for those that are not."""
    first = np.zeros(len(tok), bool)
    first[at[:-1]] = True
    before = np.r_[START, tok[:-1]]
    before[first] = START
    pair = joint(before, tok, PAIR_TURN)
    prior = np.r_[np.uint64(0), pair[:-1]][~first]
    return before, pair, first, prior, joint(prior, pair[~first], TRIPLE_TURN)


def _combined(columns_of, schema):
    """Counts of rows, merged inside the task; at most FLUSH distinct are held.
    The first column that ``columns_of`` gives is a key of the others."""
    def rows(batches):
        held, n = [], 0
        for batch in batches:
            for _, data, offs in C.pieces(batch, "text"):
                x = [C.as_long(c) for c in columns_of(*tokens(data, offs))]
                if not len(x[0]):
                    continue
                held.append(_merged(*x, np.ones(len(x[0]), np.int64)))
                n += len(held[-1][0])
                if n >= FLUSH:
                    held = [_merged(*map(np.concatenate, zip(*held)))]
                    n = len(held[0][0])
                    if n >= FLUSH // 2:
                        yield C.record(schema, *held[0][1:])
                        held, n = [], 0
        if held:
            yield C.record(schema, *_merged(*map(np.concatenate, zip(*held)))[1:])
    return rows


def _merged(*columns):
    """Rows of equal first column as one, the last column added up."""
    order = np.argsort(columns[0], kind="stable")
    k = columns[0][order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return (k[at], *[x[order[at]] for x in columns[1:-1]], np.add.reduceat(columns[-1][order], at))


def _total(train: DataFrame, columns_of, names: list[str]) -> DataFrame:
    """Counts ``c`` by the named columns."""
    schema = pa.schema([(x, pa.int64()) for x in [*names, "c"]])
    return (train.select("text").mapInArrow(_combined(columns_of, schema), ", ".join(f"{x} long" for x in [*names, "c"]))
            .groupBy(*names).agg(F.sum("c").alias("c")))


@contextmanager
def short_shuffles(spark):
    """Inside, shuffle files are deleted when the job that wrote them ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, had)


def _filter(table: DataFrame, key: str) -> np.ndarray:
    """Bloom filter of a table's keys: three bits of one of BLOCKS 64-bit words."""
    bits = " | ".join(f"shiftleft(1L, cast(shiftright({key}, {k}) & 63 as int))" for k in (21, 27, 33))
    t = (table.select(F.expr(f"{key} & {BLOCKS - 1}L").alias("i"), F.expr(bits).alias("b"))
         .groupBy("i").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(BLOCKS, np.uint64)
    out[t.column("i").to_numpy()] = t.column("b").to_numpy().view(np.uint64)
    return out


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    x, one, low = keys.view(np.uint64), np.uint64(1), np.uint64(63)
    m = one << (x >> np.uint64(21) & low) | one << (x >> np.uint64(27) & low) | one << (x >> np.uint64(33) & low)
    return bits[(x & np.uint64(BLOCKS - 1)).view(np.int64)] & m == m


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in sorted keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(x), -1, np.int64)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[i] == x, i, -1)


class Automaton:
    """States: 0 root, 1..W words, W+1 start of text, then pairs; arcs by state * W + word.
    A state without arcs (its backoff weight is NaN) is not entered: the walk goes
    to the one that its failure arc would lead to."""

    def __init__(self, one, word_back, pv, pw, two, pair_back, ts, tq, tw, three):
        """``one``: log-probability of each of the W words; ``word_back``: backoff weight of
        the W words and the start; pairs: first word (W: start), second word, log-probability
        and backoff weight; triples: first and last pair in them, last word, log-probability."""
        size = self.size = len(one)
        self.one = one.tolist()
        enter = np.where(np.isnan(word_back), 0, 1 + np.arange(size + 1))
        self.enter, self.start = enter.tolist(), int(enter[size])
        self.back = np.nan_to_num(np.concatenate([[0.0], word_back, pair_back])).tolist()
        self.fail = np.concatenate([np.zeros(size + 2, np.int64), enter[pw]]).tolist()
        state = np.where(np.isnan(pair_back), enter[pw], size + 2 + np.arange(len(pw)))
        keys = np.concatenate([(1 + pv) * size + pw, (size + 2 + ts) * size + tw])
        self.arcs = dict(zip(keys.tolist(), zip(np.concatenate([two, three]).tolist(), np.concatenate([state, state[tq]]).tolist())))

    @classmethod
    def of_block(cls, tok, at, models, unknown):
        """The part that the texts ``tok``, ``at`` can reach, from rows of the model
        (hash sorted, log-probability, backoff weight) in one or more tables; also the
        texts' word numbers and which words are known."""
        def rows(keys):
            hit, logp, back = np.zeros(len(keys), bool), np.zeros(len(keys)), np.full(len(keys), np.nan)
            for h, of_logp, of_back in models:
                place = _find(h, keys)
                own = place >= 0
                hit |= own
                logp[own], back[own] = of_logp[place[own]], of_back[place[own]]
            return hit, logp, back
        words, ids = np.unique(tok, return_inverse=True)
        size = len(words)
        known, own, word_back = rows(C.as_long(words))
        _, _, start_back = rows(C.as_long(np.array([START])))
        _, pair, first, _, triple = grams(tok, at)
        pairs, where, which = np.unique(pair, return_index=True, return_inverse=True)
        hit, two, pair_back = rows(C.as_long(pairs))
        number = np.cumsum(hit) - 1
        where = where[hit]
        pv = np.where(first[where], size, ids[where - 1])
        later = np.flatnonzero(~first)
        may = hit[which[later - 1]] & hit[which[later]]  # a triple's two pairs are in the model
        triples, i = np.unique(triple[may], return_index=True)
        hit3, three, _ = rows(C.as_long(triples))
        i = later[may][i[hit3]]
        automaton = cls(unknown + own, np.r_[word_back, start_back], pv, ids[where], two[hit], pair_back[hit],
                        number[which[i - 1]], number[which[i]], ids[i], three[hit3])
        return automaton, ids, known

    def walk(self, ids: list[int]) -> float:
        """Log10 probability of a text's words, left to right."""
        arcs, back, fail, size = self.arcs, self.back, self.fail, self.size
        state, total = self.start, 0.0
        for w in ids:
            while state:
                arc = arcs.get(state * size + w)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                total += back[state]
                state = fail[state]
            else:
                total += self.one[w]
                state = self.enter[w]
        return total


def arcs(train: DataFrame, counts: DataFrame, n: int, v: int, word_least: float, least: float) -> DataFrame:
    """h, c, logp (of a word: over that of an unknown one) and back (backoff weight of the
    state, null where no arc leaves it) of all words, pairs and triples of the model."""
    spark, before = train.sparkSession, set(scratch_tables())
    unknown = n + 0.5 * (v + 1)
    start, end = int(START.view(np.int64)), int(END.view(np.int64))
    kept = counts.where(F.col("c") >= word_least)
    contexts = kept.select(F.col("h").alias("v"), F.col("c").alias("of")).union(
        counts.where(F.col("h") == end).select(F.lit(start).cast("long"), "c"))

    def pair_columns(tok, at):
        before, pair, *_ = grams(tok, at)
        return pair, before, tok
    pairs = _total(train, pair_columns, ["v", "w"]).where(F.col("c") >= least).withColumn("p", joint_column("v", "w", PAIR_TURN))
    pairs = materialize(pairs.join(contexts, "v").join(kept.select(F.col("h").alias("w"), ((F.col("c") + 0.5) / unknown).alias("one")), "w")
                        .select("p", "v", "c", ((F.col("c") - DISCOUNT) / F.col("of")).alias("two"), "one"), "pairs")
    held = spark.sparkContext.broadcast(_filter(pairs, "p"))

    def triple_columns(tok, at):
        _, pair, first, prior, triple = grams(tok, at)
        pair = pair[~first]
        may = _maybe(held.value, C.as_long(prior)) & _maybe(held.value, C.as_long(pair))
        return triple[may], prior[may], pair[may]
    triples = _total(train, triple_columns, ["p", "q"]).where(F.col("c") >= least).withColumn("t", joint_column("p", "q", TRIPLE_TURN))
    triples = materialize(triples.join(pairs.select("p", F.col("c").alias("of")), "p").join(pairs.select(F.col("p").alias("q"), F.col("two").alias("lower")), "q")
                          .select("t", "p", "c", ((F.col("c") - DISCOUNT) / F.col("of")).alias("three"), "lower"), "triples")

    left = lambda c: F.greatest(1 - F.sum(c), F.lit(1e-12))
    back = materialize(pairs.groupBy(F.col("v").alias("state")).agg(F.log10(left("two") / left("one")).alias("back"))
                       .union(triples.groupBy("p").agg(F.log10(left("three") / left("lower")))), "states")
    none = F.lit(None).cast("double")
    words = counts.join(back.withColumnRenamed("state", "h"), "h", "left").select("h", "c", F.log10(2 * F.col("c") + 1).alias("logp"), "back")
    begin = back.where(F.col("state") == start).join(contexts.withColumnRenamed("v", "state"), "state").select("state", "of", none, "back")
    two = pairs.join(back.withColumnRenamed("state", "p"), "p", "left").select("p", "c", F.log10("two"), "back")
    out = materialize(words.union(begin).union(two).union(triples.select("t", "c", F.log10("three"), none)), "arcs")
    discard(spark, [x for x in scratch_tables() if x not in before], out)
    return out


_DEALT = "block long, doc_id long, held_out boolean, text string"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_SCORE_PA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                       ("base_score", pa.float64()), ("score", pa.float64())])
_ASK_PA = pa.schema([("block", pa.int64()), ("h", pa.int64())])


def _dealt(size: int):
    """Rows with their block: neighbours, ``size`` bytes of text or one longer text."""
    def rows(batches):
        used = TaskContext.get().partitionId() << 43
        for batch in batches:
            _, offs = C.buffers(batch.column("text"))
            block = pa.array((used + offs[:-1]) // size)
            used += int(offs[-1])
            yield pa.RecordBatch.from_arrays([block, *batch.columns], names=["block", *batch.schema.names])
    return rows


def _asked(cache):
    """The distinct n-grams of each block that may be in the model and are not cached."""
    def rows(batches):
        held, _, _, bits = cache.value
        now, have = None, []

        def flush():
            h = np.unique(np.concatenate(have))
            return C.record(_ASK_PA, np.full(len(h), now), h)
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)] if len(block) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if have and block[a] != now:
                    yield flush()
                    have = []
                now = block[a]
                for _, data, offs in C.pieces(batch.slice(a, b - a), "text"):
                    tok, at = tokens(data, offs)
                    _, pair, first, _, triple = grams(tok, at)
                    may, later = _maybe(bits, pair), np.flatnonzero(~first)
                    triple = triple[may[later - 1] & may[later]]
                    h = np.concatenate([tok[_maybe(bits, tok)], [START], pair[may], triple[_maybe(bits, triple)]])
                    h = np.unique(C.as_long(h))
                    have.append(h[_find(held, h) < 0])
        if have:
            yield flush()
    return rows


def _walked(cache, unknown: float):
    """Scores of a block's texts, from the block's answers and the cached arcs."""
    def block(docs: pa.Table, answers: pa.Table) -> pa.Table:
        text = docs.column("text").combine_chunks()
        tok, at = tokens(*C.buffers(text))
        h, logp, back = (answers.column(x).to_numpy() for x in ("h", "logp", "back"))
        h, first = np.unique(h, return_index=True)
        own = (h, *(x.astype(np.float64)[first] for x in (logp, back)))
        automaton, ids, known = Automaton.of_block(tok, at, [own, cache.value[:3]], unknown)
        n = len(text)
        of = np.repeat(np.arange(n), np.diff(at))
        cuts = at.tolist()
        score = [automaton.walk(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.Table.from_batches([C.record(_SCORE_PA, docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), np.diff(at),
                                               np.bincount(of, known[ids], n).astype(np.int64), np.bincount(of, np.array(automaton.one)[ids], n), score)])
    return block


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", word_share: float = 0.0, gram_share: float = 0.0,
                    cached: int = CACHED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  A
    ``word_share`` or ``gram_share`` of all tokens asks for a smaller model."""
    spark = docs.sparkSession
    with short_shuffles(spark):
        return _scored(spark, docs, text, doc_id, word_share, gram_share, cached)


def _scored(spark, docs: DataFrame, text: str, doc_id: str, word_share: float, gram_share: float, cached: int) -> DataFrame:
    before = set(scratch_tables())
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    rows = C.bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), (F.crc32(ident) % 5 == 1).alias("held_out"),
                                          F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = materialize(_total(train, lambda tok, at: (tok, tok), ["h"]), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = arcs(train, counts, n, v, word_share * n, max(LEAST, gram_share * n))
    step = F.floor(8 * F.log2("c"))  # as many arcs as fit, by count
    least_step, room = 1 << 10, cached
    for k, arcs_of in sorted(model.groupBy(step).count().collect(), reverse=True):
        room -= arcs_of
        if room < 0:
            break
        least_step = k
    top = model.where(step >= least_step).toArrow()
    order = np.argsort(top.column("h").to_numpy())
    cache = spark.sparkContext.broadcast((top.column("h").to_numpy()[order], *[top.column(x).to_numpy().astype(np.float64)[order] for x in ("logp", "back")],
                                          _filter(model, "h")))
    unknown = float(np.log10(0.5 / (n + 0.5 * (v + 1))))
    dealt = materialize(rows.mapInArrow(_dealt(BLOCK), _DEALT), "blocks")
    out = []
    for k in range(ROUNDS):
        own = dealt.where(F.pmod("block", F.lit(ROUNDS)) == k)
        answers = own.select("block", "text").mapInArrow(_asked(cache), "block long, h long").join(model.where(step < least_step).select("h", "logp", "back"), "h")
        walked = own.groupBy("block").cogroup(answers.select("block", "h", "logp", "back").groupBy("block")).applyInArrow(_walked(cache, unknown), _SCORE)
        out.append(materialize(walked, "scores"))
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    discard(spark, [x for x in scratch_tables() if x not in before], found)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
