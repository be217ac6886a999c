"""Suffix-array dedup: remove bytes of passages that occur more than once.

The repeated passages come from longest-previous-factor arrays.  For a text x
with suffix array SA, LPF[i] is the longest factor at i that also starts at an
earlier place; it is reached at the nearest smaller positions before and after
i in suffix order (PSV, NSV).  Here only "LPF[i] >= length" is asked, so the
order is that of the first ``length`` bytes with ties by position: the suffixes
that share ``length`` bytes are then one run of ascending positions, in which
the previous smaller position of i is its left neighbour (none smaller follows),
and the later copies are those on its right.

The corpus is not one array in one place: ``windows`` finds by anchors which
stretches can share ``length`` bytes at all, collapses equal stretches with
their counts, and brings those that may match together; one array is built per
batch of such stretches.  Matches never cross documents.

Cases: null text counts as empty; a text shorter than ``length`` is kept whole;
rows repeated whole are copies of each other (their text goes, or stays once
with keep="first" by key order -- equal keys count as one place and stay); an
empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import common as C
from trapline.llm.windows import repeated_spans

LENGTH = 400
GRAM = 150


def _ranks(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    v = values[order]
    out = np.empty(len(v), np.uint64)
    out[order] = np.cumsum(np.r_[0, v[1:] != v[:-1]]).astype(np.uint64)
    return out


def truncated_suffix_array(x: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The given starts in the order of their first ``length`` symbols, ties by
    position, and whether each shares all of them with the one before it.
    Prefix multiplying: ranks of 8 bytes give those of 24, 72, ... symbols."""
    n = len(x)
    bits = max(1, int(n).bit_length())
    width, step = 1, max(2, min(3, 63 // bits))
    rank = x.astype(np.uint64)
    if length >= 8:
        padded = np.concatenate([rank, np.zeros(7, np.uint64)])
        rank = np.zeros(n, np.uint64)
        for j in range(8):
            rank = (rank << np.uint64(8)) | padded[j:j + n]
        width = 8
    rank = _ranks(rank)
    shift = np.uint64(bits)
    while width * step < length:
        key = rank
        for j in range(1, step):
            key = (key << shift) | np.concatenate([rank[j * width:], np.zeros(min(j * width, n), np.uint64)])[:n]
        rank, width = _ranks(key), width * step
    key = rank[starts]
    for lag in sorted({min(j * width, length - width) for j in range(1, step)}):
        key = (key << shift) | rank[starts + lag]
    order = np.lexsort((starts, key))
    key = key[order]
    return order, np.r_[False, key[1:] == key[:-1]]


def previous_factors(bodies: list[bytes], n: np.ndarray, copies: np.ndarray, length: int, every: bool) -> np.ndarray:
    """For each of the first n[k] starts of each body, one after another: LPF >=
    length, or, with ``every``, such a factor at any other place.  The arrays
    cover the bodies in their order."""
    x = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    base = np.cumsum(sizes) - sizes
    starts = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())
    order, same = truncated_suffix_array(x, starts, length)
    earlier = same                     # PSV: the left neighbour of its run
    later = np.r_[same[1:], False]     # the next place of the run
    flag = np.zeros(len(starts), bool)
    flag[order] = (earlier | later) if every else earlier
    return flag


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_OUT_PA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                     ("n_spans", pa.int64()), ("kept", pa.binary())])


def cover(n: int, starts, ends) -> np.ndarray:
    """Whether each of n symbols lies in one of the spans."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def _apply(batches):
    for batch in batches:
        for part, data, offs in C.pieces(batch, "text"):
            n, gone, runs, kept = np.diff(offs), [], [], []
            spans = part.column("spans").to_pylist()
            for k, sp in enumerate(spans):
                raw = data[offs[k]:offs[k + 1]]
                if not sp:
                    gone.append(0)
                    runs.append(0)
                    kept.append(raw.tobytes())
                    continue
                out = cover(len(raw), [s["start"] for s in sp], [s["end"] for s in sp])
                gone.append(int(out.sum()))
                runs.append(int(out[0]) + int((out[1:] & ~out[:-1]).sum()))
                kept.append(raw[~out].tobytes())
            yield C.record(_OUT_PA, part.column("doc_id"), n, gone, runs, pa.array(kept, pa.binary()))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with the array of their spans (null: none)."""
    by_key = spans.groupBy("did", "tkey").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return rows.join(by_key, ["did", "tkey"], "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", text: str = "text",
                   doc_id: str = "doc_id", gram: int = GRAM) -> DataFrame:
    """Each document without the bytes of repeated ``length``-byte strings:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).
    keep="first" leaves the first place of each string, by (doc_id, position)."""
    rows = C.keyed(docs, text, doc_id)
    spans = repeated_spans(rows, "byte", length, min(gram, length), previous_factors, keep == "first")
    return with_spans(rows, spans).mapInArrow(_apply, _OUT)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                       F.sha2("kept", 256).alias("kept_sha256"))
