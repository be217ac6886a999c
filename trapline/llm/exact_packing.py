"""Best-fit packing by exact complements.

Texts are tokenised, closed by an end token and, where longer than a sequence, cut
into full pieces and a rest.  Packing depends on lengths alone, and there are at
most ``capacity`` of them, so the plan is made on a table of counts by length, one
row a length however many pieces there are.  The plan opens a sequence with the
longest length left and looks for a combination that fills the gap exactly: one
length, two or three, from indexes of the lengths left and of their pair sums, kept
up as lengths run out.  If there is none, the longest length that fits goes in (the
best fit for the gap) and the smaller gap is looked up again, until it is filled or
nothing left fits.  The combination found is used as often as its counts allow, as
one pattern; each pattern halves at least one length's count, so there are at most
capacity x log2(count) of them.  Plans with combinations of at most two and of one
are made too, unless the first needs no more sequences than the tokens fill.

Pieces meet the plan by their number within their length: a running number
inside the task that wrote them, plus the counts of the tasks before, from a written
table.  So a length that holds a third of all pieces is spread like any other.  The
plan's intervals of numbers (bounded as above) go to all tasks.

Words, cut between letters, digits and marks, are tokenised once a batch: the ids
of such a unit do not depend on what stands around it.

Cases: null and empty texts are one piece of the end token alone; repeated rows are
pieces of their own; a text of exactly n sequences has no empty rest; an
empty table gives an empty result; columns other than the two named are ignored."""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm import common as C
from trapline.session import materialize

CAPACITY, END_ID = 4096, 1
KNOWN_WORDS = 400_000


# bytes by what they are to the split pattern: letters, digits, marks other than the apostrophe
LETTER, DIGIT, MARK = np.zeros((3, 256), bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = DIGIT[0x30:0x3A] = True
MARK[0x21:0x7F] = True
MARK[0x27] = False
MARK &= ~LETTER & ~DIGIT


def units(data: np.ndarray, offs: np.ndarray):
    """Parts of texts that have the same ids wherever they stand: words, cut
    between letters, digits and marks as the split pattern cuts them, too.  A
    unit is ``plain`` if it is all Latin-1 letters; those are lower-cased here, as
    the file asks, so that fewer differ.  Words with "<|" (they may hold added
    tokens) stay whole, and so does all around an apostrophe or other characters.
    Returns the bytes, unit starts and ends, and each text's offset in them."""
    s, e, _ = C.words(data, offs)
    letter, digit, mark = LETTER[data], DIGIT[data], MARK[data]
    wide = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for the signs x and /
    wide = wide[(data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)]
    letter[wide] = letter[wide + 1] = True
    solid = letter | digit
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (solid[:-1] & (mark | digit)[1:]) | ((mark | digit)[:-1] & solid[1:])
    added = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    if len(added):
        words = np.unique(np.searchsorted(s, added, "right") - 1)
        cut[C.ragged(s[words], e[words] - s[words])] = False
        letter[C.ragged(s[words], e[words] - s[words])] = False
    start, end = cut.copy(), cut
    start[s] = True
    end[e] = True
    # a cut at a word's own edge is none
    s, e = np.flatnonzero(start[:-1]), np.flatnonzero(end)
    odd = np.r_[0, np.cumsum(~letter)]
    plain = odd[e] == odd[s]
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] += 0x20
    up = wide[data[wide + 1] < 0x9F] + 1
    low[up] += 0x20
    inside = C.ragged(s[~plain], (e - s)[~plain])
    low[inside] = data[inside]
    return low, s, e, np.searchsorted(s, offs)


class Words:
    """Ids of units by the tokenizers library, one thread, with a bounded table
    of units already encoded: places in one array of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        suffix = json.loads(self.tok.to_str())["model"]["end_of_word_suffix"]
        self.closes = np.zeros(self.tok.get_vocab_size(), bool)
        self.closes[[i for w, i in self.tok.get_vocab().items() if w.endswith(suffix)]] = True
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.empty(1 << 20, np.uint32), np.zeros(1, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray):
        at = int(self.ends[-1])
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[at:at + len(ids)] = ids
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ends = np.concatenate([self.ends, at + np.cumsum(size)])

    def _learn(self, words: list[str]):
        # a run of letters is one word to the model, whose last id says that it closes one: all in one text
        one, rest = [], []
        for w in words:
            (one if w.isalpha() and w[-1] <= "ÿ" and max(w) <= "ÿ" else rest).append(w)
        if one:
            ids = np.array(self.tok.encode_batch_fast([" ".join(one)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.closes[ids])
            if len(last) == len(one):
                self._add(one, ids, np.diff(last, prepend=-1))
            else:
                rest = words
        if rest:
            each = [x.ids for x in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
            self._add(rest, np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each]))

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, each with the end token, laid end to end; offsets."""
        low, s, e, wo = units(data, offs)
        size = e - s
        ends = np.zeros(len(s) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        column = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(ends), pa.py_buffer(low[~C.SEP[data]]))
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > KNOWN_WORDS:
            self._clear()
        known = self.known
        new = [w for w in distinct if w not in known]
        if new:
            self._learn(new)
        place = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        word = place[coded.indices.to_numpy()] if len(s) else np.empty(0, np.int64)
        size = self.ends[word + 1] - self.ends[word]
        before = np.r_[0, np.cumsum(size)]
        out_offs = before[wo] + np.arange(len(offs))
        out = np.full(out_offs[-1], end_id, np.uint32)
        texts = np.repeat(np.arange(len(offs) - 1), np.diff(wo))
        out[np.arange(before[-1]) + np.repeat(texts, size)] = self.ids[C.ragged(self.ends[word], size)]
        return out, out_offs


@lru_cache(2)
def load(path: str) -> Words:
    return Words(path)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, dealt long"


def pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: its place in its document, length and CRC-32 of its ids
    (``with_ids``: also ``ids``, little-endian); ``dealt`` numbers the pieces of
    equal length within a task."""
    ddl = _PIECE + (", ids binary" if with_ids else "")
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])

    def rows(batches):
        words, seen = load(path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part, data, offs in C.pieces(batch, "text", 4 * C.PIECE):
                ids, at = words.encode(data, offs, end_id)
                n = np.diff(at)
                count = (n + capacity - 1) // capacity
                doc = np.repeat(np.arange(len(n)), count)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = number * capacity
                length = np.minimum(n[doc] - start, capacity)
                raw, first = ids.astype("<u4").tobytes(), at[doc] + start
                spans = [raw[4 * a:4 * b] for a, b in zip(first.tolist(), (first + length).tolist())]
                # running number by length: sort by length, count from each group's head
                order = np.argsort(length, kind="stable")
                head = np.r_[True, length[order][1:] != length[order][:-1]]
                dealt = np.empty(len(length), np.int64)
                dealt[order] = np.arange(len(order)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                dealt += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield C.record(schema, part.column("doc_id").take(pa.array(doc)), number.astype(np.int32), start, length,
                               np.array([zlib.crc32(x) for x in spans], np.int64), dealt, *([spans] if with_ids else []))

    texts = C.bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(rows, ddl)


class Plan:
    """Patterns of lengths for a table of counts by length, as intervals: the
    pieces of length L numbered from ``lo`` on, ``each`` a sequence, go to the
    sequences from ``base`` on, at ``offset`` and then L further each."""

    def __init__(self, counts: np.ndarray, capacity: int, most: int = 3):
        self.most = most
        self.left = counts.astype(np.int64).copy()
        self.capacity, self.used = capacity, np.zeros(capacity + 1, np.int64)
        self.some = self.left > 0
        self.some[0] = False
        # pair sums: how many pairs of lengths left (two of one need two pieces) have each sum
        self.pairs = np.zeros(2 * capacity + 1, np.int64)
        lengths = np.flatnonzero(self.some)
        for x in lengths:
            np.add.at(self.pairs, x + lengths[lengths > x], 1)
        np.add.at(self.pairs, 2 * lengths[self.left[lengths] > 1], 1)
        self.lines: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self._fill()

    def _take(self, length: int, n: int):
        had = self.left[length]
        self.left[length] = now = had - n
        if had > 1 >= now:
            self.pairs[2 * length] -= 1
        if now == 0:
            self.some[length] = False
            # another length's pairs with it; its pair with itself went above
            self.pairs[length + np.flatnonzero(self.some)] -= 1

    def _one(self, gap: int, need: dict) -> tuple | None:
        return (gap,) if gap <= self.capacity and self.left[gap] > need.get(gap, 0) else None

    def _two(self, gap: int, need: dict, most: int | None = None) -> tuple | None:
        """Two lengths left that make the gap, the longer as long as can be."""
        if gap < 2 or not self.pairs[gap]:
            return None
        top = min(gap - 1, self.capacity if most is None else most)
        half = (gap + 1) // 2
        if top < half:
            return None
        a = np.arange(top, half - 1, -1)
        for x in a[self.some[a] & self.some[gap - a]].tolist():
            y = gap - x
            if (self.left[x] - need.get(x, 0) > (x == y)) and self.left[y] > need.get(y, 0):
                return x, y
        return None

    def _three(self, gap: int, need: dict) -> tuple | None:
        top = min(gap - 2, self.capacity)
        low = (gap + 2) // 3
        if top < low:
            return None
        a = np.arange(top, low - 1, -1)
        for x in a[self.some[a] & (self.pairs[gap - a] > 0)].tolist():
            if self.left[x] > need.get(x, 0):
                rest = self._two(gap - x, {**need, x: need.get(x, 0) + 1}, x)
                if rest:
                    return x, *rest
        return None

    def _fill(self):
        longest = self.capacity
        while True:
            while longest and not self.some[longest]:
                longest -= 1
            if not longest:
                return
            need, gap = {longest: 1}, self.capacity - longest
            while gap:
                exact = (self._one, self._two, self._three)[:self.most] if gap <= 3 * longest else ()
                found = next(filter(None, (look(gap, need) for look in exact)), None)
                if not found:
                    fits = np.flatnonzero(self.some[:gap + 1])[::-1]
                    found = next(((int(x),) for x in fits if self.left[x] > need.get(int(x), 0)), None)
                    if not found:
                        break
                    x = found[0]
                    # far from the end no combination can fill the gap: go on with the same length
                    more = min(int(self.left[x]) - need.get(x, 0), max(1, (gap - 3 * longest) // x))
                    found = (x,) * more
                for x in found:
                    need[x] = need.get(x, 0) + 1
                    gap -= x
            self._use(need)

    def _use(self, need: dict):
        times = min(int(self.left[x]) // n for x, n in need.items())
        offset = 0
        for x, n in sorted(need.items(), reverse=True):
            self.lines.append((x, int(self.used[x]), n, self.sequences, offset))
            offset += n * x
            self.used[x] += times * n
            self._take(x, times * n)
        self.sequences += times

    def table(self) -> np.ndarray:
        """Columns: first global number (lengths laid end to end), pieces each, first sequence, offset."""
        first = np.r_[0, np.cumsum(self.used)]
        t = np.array(self.lines, np.int64).reshape(-1, 5)
        t = np.column_stack([first[t[:, 0]] + t[:, 1], t[:, 2:], ])
        return t[np.argsort(t[:, 0], kind="stable")]


def best_plan(counts: np.ndarray, capacity: int) -> Plan:
    """The plan of fewest sequences with combinations of up to three, two and
    one lengths: where few small pieces are left for many large gaps, spending
    two of them on one exact fill can cost a sequence elsewhere."""
    least = -(-int(counts @ np.arange(capacity + 1)) // capacity)
    best = None
    for most in (3, 2, 1):
        plan = Plan(counts, capacity, most)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (rows of ``pieces``, any further columns) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = materialize(cut.withColumn("task", F.spark_partition_id()), "pieces")
    by_task = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece_counts")
    totals = by_task.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # one row a length, at most ``capacity``
    counts = np.zeros(capacity + 1, np.int64)
    counts[totals["length"].to_numpy()] = totals["n"].to_numpy()
    plan = best_plan(counts, capacity).table()
    first = np.cumsum(counts) - counts
    shared = spark.sparkContext.broadcast((plan, first))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    numbered = cut.join(by_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before")), ["task", "length"])

    def rows(batches):
        plan, first = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = first[length] + batch.column("before").to_numpy() + batch.column("dealt").to_numpy()
            line = plan[np.searchsorted(plan[:, 0], number, "right") - 1]
            turn = number - line[:, 0]
            names = [c for c in batch.schema.names if c not in ("task", "before", "dealt")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(line[:, 2] + turn // line[:, 1]), pa.array(line[:, 3] + turn % line[:, 1] * length)],
                                             names=[*names, "sequence_id", "offset"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name not in ("task", "dealt")]
    return numbered.select(*cut.columns, "before").mapInArrow(rows, ", ".join([*kept, "sequence_id long", "offset long"]))


def op13(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
