"""Substring dedup: suffix automata of reference shards.

Reference shards are the stretches of text that can hold a repeated window at
all (``windows``), dealt by anchor hash; each shard becomes a suffix automaton
over words, and the stretches of documents are streamed through it.  After each
word the state is cut back along suffix links to the longest ``length`` words
(the matching statistic); the number of end positions of that state tells
whether the window occurs at another place, its first end position whether at
an earlier one.  Windows found become spans, spans of one document merge into
maximal ones.

A shard goes to the one task that streams the stretches of its anchors and not
to all tasks: equal windows always have equal anchors, so no other task could
match it, and nothing that grows with the corpus is broadcast.

Cases: null text has no words; a document of under ``length`` words is kept
unchanged; rows repeated whole are copies of each other; an empty table gives an
empty result; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.llm import common as C
from trapline.llm.suffix_dedup import cover, with_spans
from trapline.llm.windows import repeated_spans

LENGTH = 35
GRAM = 16


class SuffixAutomaton:
    """Of a sequence of hashable symbols: arcs, suffix links, longest lengths,
    first end position and number of end positions of each state."""

    def __init__(self, symbols):
        arcs, link, size, first, ends = [{}], [-1], [0], [-1], [0]
        last = 0
        for i, a in enumerate(symbols):
            cur = len(arcs)
            arcs.append({})
            link.append(0)
            size.append(size[last] + 1)
            first.append(i)
            ends.append(1)
            p = last
            while p >= 0 and a not in arcs[p]:
                arcs[p][a] = cur
                p = link[p]
            if p >= 0:
                q = arcs[p][a]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    twin = len(arcs)
                    arcs.append(arcs[q].copy())
                    link.append(link[q])
                    size.append(size[p] + 1)
                    first.append(first[q])
                    ends.append(0)
                    while p >= 0 and arcs[p].get(a) == q:
                        arcs[p][a] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        for s in np.argsort(-np.array(size), kind="stable").tolist():
            if link[s] >= 0:
                ends[link[s]] += ends[s]
        self.arcs, self.link, self.size, self.first, self.ends = arcs, link, size, first, ends


def matches(bodies: list[bytes], n: np.ndarray, copies: np.ndarray, length: int, every: bool) -> np.ndarray:
    """For each of the first n[k] windows of each body: whether it occurs at
    another (every) or an earlier place of the shard."""
    _, ids = np.unique(np.frombuffer(b"".join(bodies), np.uint64), return_inverse=True)
    sizes = [len(b) // 8 for b in bodies]
    shard, at = [], 0
    ids = ids.tolist()
    for k, m in enumerate(sizes):
        shard += ids[at:at + m]
        shard.append(-1 - k)  # no match crosses two bodies
        at += m
    ref = SuffixAutomaton(shard)
    arcs, link, size, first, ends = ref.arcs, ref.link, ref.size, ref.first, ref.ends
    flag, at, pos = [], 0, 0
    for m in sizes:
        state = 0
        for i in range(m):
            state = arcs[state][ids[at + i]]  # the stretch itself lies in the shard
            while size[link[state]] >= length:
                state = link[state]
            if i >= length - 1:
                flag.append(ends[state] > 1 if every else first[state] < pos + i)
        at += m
        pos += m + 1
    return np.array(flag, bool)


_OUT = "doc_id long, n_words long, n_removed long, n_spans long, kept string"
_OUT_PA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                     ("n_spans", pa.int64()), ("kept", pa.string())])


def _apply(batches):
    for batch in batches:
        for part, data, offs in C.pieces(batch, "text"):
            s, e, wo = C.words(data, offs)
            spans, raw = part.column("spans").to_pylist(), data.tobytes()
            gone, runs, kept = [], [], []
            for k, sp in enumerate(spans):
                a, b = wo[k], wo[k + 1]
                keep = np.ones(b - a, bool)
                if sp:
                    keep = ~cover(b - a, [x["start"] for x in sp], [x["end"] for x in sp])
                gone.append(int((~keep).sum()))
                out = ~keep
                runs.append(int(out[:1].sum()) + int((out[1:] & ~out[:-1]).sum()))
                kept.append(b" ".join([raw[x:y] for x, y in zip(s[a:b][keep].tolist(), e[a:b][keep].tolist())]))
            yield C.record(_OUT_PA, part.column("doc_id"), np.diff(wo), gone, runs, pa.array(kept, pa.binary()).cast(pa.string()))


def remove_spans(docs: DataFrame, length: int = LENGTH, keep: str = "none", text: str = "text",
                 doc_id: str = "doc_id", gram: int = GRAM) -> DataFrame:
    """Each document without the words of repeated windows of ``length`` words:
    doc_id, n_words, n_removed, n_spans, kept (words joined by one space)."""
    rows = C.keyed(docs, text, doc_id)
    spans = repeated_spans(rows, "word", length, min(gram, length), matches, keep == "first")
    return with_spans(rows, spans).mapInArrow(_apply, _OUT)


def cleaned(docs: DataFrame, length: int = LENGTH, keep: str = "none", text: str = "text", doc_id: str = "doc_id",
            chars: str = "n_chars", gram: int = GRAM) -> DataFrame:
    """The documents with their columns.  Where words were removed the text is
    what ``kept`` holds, and ``chars`` (if there is such a column) its length;
    all other texts stay as they are, white space included."""
    rows = C.keyed(docs, text, doc_id)
    spans = repeated_spans(rows, "word", length, min(gram, length), matches, keep == "first")
    by_key = spans.groupBy("did", "tkey").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = docs.select(row, F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("did"), F.xxhash64(F.col(doc_id).cast("long"), t).alias("tkey"))
    whole = whole.join(by_key, ["did", "tkey"], "left").select(
        "row", F.when(F.col("spans").isNotNull(), F.coalesce(F.col("row")[text].cast("string"), F.lit(""))).otherwise(F.lit("")).alias("text"), "spans")
    out = T.StructType([whole.schema["row"], T.StructField("kept", T.StringType())])

    def cut(batches):
        for batch in batches:
            own = batch.select(["row"])
            kept = [x for b in _apply(iter([_numbered(batch)])) for x in b.column("kept").to_pylist()]
            hit = np.diff(batch.column("spans").offsets.to_numpy()) > 0 if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([k if h else None for k, h in zip(kept, hit)], pa.string())], ["row", "kept"])
    whole = whole.mapInArrow(cut, out)
    new = {text: F.coalesce("kept", F.col("row")[text])}
    if chars in docs.columns:
        new[chars] = F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema[chars].dataType)).otherwise(F.col("row")[chars])
    return whole.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _numbered(batch):
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int64)), batch.column("text"), batch.column("spans")], ["doc_id", "text", "spans"])


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_spans(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
