"""Helpers shared by the operators: keyed document rows, text buffers in Arrow
batches, and vectorised hashing of bytes and words.

Hashes are 64 bits, polynomial over a prefix sum and then mixed, so the hash of
any span of a text costs two lookups.  Every function here handles one slice of
an Arrow batch at a time (about ``PIECE`` bytes), which bounds memory whatever
the size of the partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
_U = np.uint64


def mix(x):
    """Bijective finaliser: spreads every input bit over the 64 output bits."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
BYTE = mix(np.arange(1, 257, dtype=np.uint64))
SEP = np.zeros(256, dtype=bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums that ``span_hash`` takes differences of."""
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * powers(_BASE, len(symbols)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end], the same wherever the span lies."""
    return mix((sums[end] - sums[start]) * powers(_UNBASE, len(sums))[start] + (end - start).astype(np.uint64))


def roll_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive symbols."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:-width]) * powers(_UNBASE, max(n, 1))[:n] + _U(width))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, wide = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[off[0]:off[-1]], off - off[0]


def pieces(batch, column: str, most: int = PIECE):
    """Slices of a record batch with about ``most`` bytes of text each, at
    least one row: (slice, bytes, offsets)."""
    _, off = buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        part = batch.slice(i, min(j, n) - i)
        yield part, *buffers(part.column(column))
        i = min(j, n)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end: byte starts,
    byte ends, and each text's offset in them."""
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    sep = SEP[data]
    start, end = ~sep, ~sep
    if n:
        start[1:] &= sep[:-1] | first[1:n]
        end[:-1] &= sep[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return span_hash(prefix(BYTE[data]), s, e)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(x.dtype).max, dtype=x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lets Arrow batches hold 1,000 rows, not 10,000, unless the session has a
    setting of its own: rows here are whole texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, "1000")
    return df


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text (null: empty) and the row's key (did, tkey): rows of equal
    key have the same id and the same text, hence the same result.  Columns of
    any other name are left behind, so they cannot clash."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = bounded_batches(docs)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"),
                       F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("did"),
                       F.xxhash64(F.col(doc_id).cast("long"), t).alias("tkey"))


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start[0], start[0] + 1, ... of spans laid end to end."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)


def joined(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words data[s:e], each followed by one space, laid end to end, and the
    place of each word's first byte (and one past the last space)."""
    places = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s + 1, out=places[1:])
    out = np.full(places[-1], 0x20, np.uint8)
    out[ragged(places[:-1], e - s)] = data[ragged(s, e - s)]
    return out, places
