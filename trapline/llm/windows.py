"""Windows of symbols that start more than once anywhere in a corpus.

A window is ``length`` consecutive symbols (bytes or words) of one text.  Among
the ``gram``-symbol grams inside a window the one of least hash is its anchor,
so equal windows have equal anchors in the same place.  Consecutive windows of
one text that share an anchor form a *block*; every window lies in exactly one
block, and two equal windows always lie in blocks of the same anchor hash.  So

1. one pass gives a row per block (two per ``length - gram`` symbols);
2. equal blocks are counted with map-side combining: all windows of a block
   that occurs twice are repeated, whatever the size of that group;
3. what is left are blocks whose anchor is shared but whose content is not (the
   ends of shared passages).  Only their symbols are fetched, once for each
   distinct content, and a *resolver* (suffix array or suffix automaton) finds
   their repeated windows, group of anchor by group of anchor;
4. an anchor with over ``LARGE`` contents is not handed to one task: each of
   its windows becomes a row and rows of equal hash are counted.

Nothing is capped: each case ends in an exact answer (64-bit hashes within the
64-bit hash of the anchor)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import common as C
from trapline.session import materialize

LARGE = 2000
BATCH = 1 << 18

_BLOCK = "did long, tkey long, start int, n int, h long, ch long"
_BLOCK_PA = pa.schema([("did", pa.int64()), ("tkey", pa.int64()), ("start", pa.int32()), ("n", pa.int32()),
                       ("h", pa.int64()), ("ch", pa.int64())])
_BODY = "h long, ch long, nc long, c long, did long, tkey long, start int, n int, body binary"
_BODY_PA = pa.schema([("h", pa.int64()), ("ch", pa.int64()), ("nc", pa.int64()), ("c", pa.int64()),
                      ("did", pa.int64()), ("tkey", pa.int64()), ("start", pa.int32()), ("n", pa.int32()),
                      ("body", pa.binary())])
_SPAN = "did long, tkey long, start int, end int"
_SPAN_PA = pa.schema([("did", pa.int64()), ("tkey", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
_WINDOW = "h long, at int, wh long, did long, tkey long, pos int"
_WINDOW_PA = pa.schema([("h", pa.int64()), ("at", pa.int32()), ("wh", pa.int64()), ("did", pa.int64()),
                        ("tkey", pa.int64()), ("pos", pa.int32())])


def symbols(data: np.ndarray, offs: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit symbol per byte or per word, and each text's offset."""
    if unit == "byte":
        return C.BYTE[data], offs
    s, e, wo = C.words(data, offs)
    return C.word_hashes(data, s, e), wo


def blocks(sym: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(text index, first window, windows, anchor hash, content hash) of each
    block; window positions count from the text's start."""
    n = len(sym)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = C.prefix(sym)
    g = C.roll_hash(sums, gram)
    order = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)  # ties: the leftmost
    at = (C.sliding_min(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(n + 2, np.int64)  # windows across the end of a text
    inner = offs[1:-1]
    np.add.at(edge, np.maximum(inner - length + 1, 0), 1)
    np.add.at(edge, inner, -1)
    i = np.flatnonzero(np.cumsum(edge)[:n - length + 1] == 0)
    if not len(i):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    at = at[i]
    new = np.ones(len(i), bool)
    new[1:] = (at[1:] != at[:-1]) | (i[1:] != i[:-1] + 1)
    b = np.flatnonzero(new)
    start, cnt, at = i[b], np.diff(np.append(b, len(i))), at[b]
    ch = C.mix(C.span_hash(sums, start, start + cnt - 1 + length) + (at - start).astype(np.uint64))
    doc = np.searchsorted(offs, start, "right") - 1
    return doc, start - offs[doc], cnt, g[at], ch


def _block_rows(unit: str, length: int, gram: int) -> Callable[[Iterator], Iterator]:
    def rows(batches):
        for batch in batches:
            for part, data, offs in C.pieces(batch, "text"):
                sym, so = symbols(data, offs, unit)
                doc, start, n, h, ch = blocks(sym, so, length, gram)
                if len(doc):
                    yield C.record(_BLOCK_PA, part.column("did").to_numpy()[doc], part.column("tkey").to_numpy()[doc],
                                   start.astype(np.int32), n.astype(np.int32), C.as_long(h), C.as_long(ch))
    return rows


def _bodies(unit: str, length: int) -> Callable[[Iterator], Iterator]:
    """The symbols of the wanted blocks of each text."""
    def rows(batches):
        for batch in batches:
            for part, data, offs in C.pieces(batch, "text"):
                raw = data
                if unit == "word":
                    sym, offs = symbols(data, offs, unit)
                    raw = sym.view(np.uint8)
                width = 8 if unit == "word" else 1
                col = part.column("want")
                flat = col.flatten()
                doc = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
                f = {k: flat.field(k).to_numpy() for k in ("h", "ch", "nc", "c", "start", "n")}
                lo = (offs[doc] + f["start"]) * width
                hi = lo + (f["n"] - 1 + length) * width
                did, tkey = part.column("did").to_numpy()[doc], part.column("tkey").to_numpy()[doc]
                for k in range(0, len(doc), 4096):
                    j = slice(k, k + 4096)
                    body = pa.array([raw[a:b].tobytes() for a, b in zip(lo[j], hi[j])], pa.binary())
                    yield C.record(_BODY_PA, f["h"][j], f["ch"][j], f["nc"][j], f["c"][j], did[j], tkey[j],
                                   f["start"][j].astype(np.int32), f["n"][j].astype(np.int32), body)
    return rows


def _resolved(resolver, length: int, every: bool) -> Callable[[Iterator], Iterator]:
    """Rows come sorted by anchor.  Whole anchor groups are gathered until they
    fill a batch (a group has at most LARGE contents, so that is bounded) and
    handed to the resolver, which tells for each window start of each body
    whether the window also starts at another place (every) or at an earlier one."""
    def flush(held):
        bodies = [r["body"] for r in held]
        n = np.array([r["n"] for r in held], np.int64)
        copies = np.array([r["c"] for r in held], np.int64)
        flag = resolver(bodies, n, copies, length, every)
        did, tkey, s, e = [], [], [], []
        base = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n)), n)
        hit = np.flatnonzero(flag)
        if len(hit):
            cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1
            first, last = hit[np.r_[0, cut]], hit[np.r_[cut - 1, len(hit) - 1]]
            for a, b in zip(first.tolist(), last.tolist()):
                o = owner[a]
                r = held[o]
                did.append(r["did"])
                tkey.append(r["tkey"])
                s.append(r["start"] + a - base[o])
                e.append(r["start"] + b - base[o] + length)
        return C.record(_SPAN_PA, did, tkey, s, e)

    def rows(batches):
        held, size, seen, last = [], 0, set(), None
        for batch in batches:
            for r in batch.to_pylist():
                if r["h"] != last:
                    if size >= BATCH:
                        yield flush(held)
                        held, size = [], 0
                    last, seen = r["h"], set()
                if r["ch"] not in seen:  # a repeated row brings the same block twice
                    seen.add(r["ch"])
                    held.append(r)
                    size += len(r["body"])
        if held:
            yield flush(held)
    return rows


def _window_rows(unit: str, length: int) -> Callable[[Iterator], Iterator]:
    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                raw = np.frombuffer(r["body"], np.uint64) if unit == "word" else C.BYTE[np.frombuffer(r["body"], np.uint8)]
                n = r["n"]
                wh = C.as_long(C.roll_hash(C.prefix(raw), length))
                yield C.record(_WINDOW_PA, np.full(n, r["h"]), np.zeros(n, np.int32), wh, np.full(n, r["did"]),
                               np.full(n, r["tkey"]), np.arange(r["start"], r["start"] + n, dtype=np.int32))
    return rows


def repeated_spans(rows: DataFrame, unit: str, length: int, gram: int, resolver, keep_first: bool = False,
                   large: int = LARGE) -> DataFrame:
    """Spans [start, end) of symbols, by key, that are covered by windows which
    also start at another place (with ``keep_first``: at an earlier one, places
    ordered by key and position).  ``rows`` are those of ``common.keyed``."""
    b = materialize(rows.select("did", "tkey", "text").mapInArrow(_block_rows(unit, length, gram), _BLOCK), "blocks")
    place = F.struct("did", "tkey", "start")
    same = materialize(b.groupBy("h", "ch").agg(F.count("*").alias("c")), "contents")
    mixed = (same.groupBy("h").agg(F.count("*").alias("nc"), F.sum((F.col("c") == 1).cast("int")).alias("n1"))
             .where("nc > 1" + ("" if keep_first else " and n1 > 0")).select("h", "nc"))
    known = same.join(mixed, "h", "left").where("c > 1 or nc is not null")
    shared = materialize(b.join(known, ["h", "ch"]), "shared")
    first = F.min(F.struct("did", "tkey", "start", "n")).alias("first")
    copies = shared.where("c > 1")
    if keep_first:
        lead = copies.groupBy("h", "ch").agg(first)
        copies = copies.join(lead, ["h", "ch"]).where(place != F.struct("first.did", "first.tkey", "first.start"))
    copies = copies.select("did", "tkey", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end"))
    want = (shared.where("nc is not null").groupBy("h", "ch").agg(first, F.first("nc").alias("nc"), F.first("c").alias("c"))
            .select("first.did", "first.tkey", F.struct("h", "ch", "nc", "c", "first.start", "first.n").alias("w"))
            .groupBy("did", "tkey").agg(F.collect_list("w").alias("want")))
    body = materialize(rows.select("did", "tkey", "text").join(want, ["did", "tkey"]).select("did", "tkey", "text", "want")
                       .mapInArrow(_bodies(unit, length), _BODY), "bodies")
    small = (body.where(F.col("nc") <= large).repartition("h").sortWithinPartitions("h", "did", "tkey", "start")
             .mapInArrow(_resolved(resolver, length, not keep_first), _SPAN))
    win = body.where(F.col("nc") > large).dropDuplicates(["h", "ch"]).mapInArrow(_window_rows(unit, length), _WINDOW)
    spot = F.struct("did", "tkey", "pos")
    seen = win.groupBy("h", "wh").agg(F.count("*").alias("k"), F.min(spot).alias("least")).where("k > 1")
    big = win.join(seen, ["h", "wh"])
    if keep_first:
        big = big.where(spot != F.col("least"))
    big = big.select("did", "tkey", F.col("pos").alias("start"), (F.col("pos") + length).alias("end"))
    return copies.unionByName(small).unionByName(big)
