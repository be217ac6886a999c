"""Periodic run detection over words, with multi-scale minimizers.

A run is a maximal stretch of words with smallest period q that holds at least
``repeats`` periods and ``least`` words.  Short periods (below 2^FIRST) come from
direct scans: for each lag, stretches of words equal to the word one lag before.
Longer ones come scale by scale.  Scale k answers for the periods in
[2^k, 2^(k+1)): of the hashes of 2^(k+1) consecutive words, the minimum of every
2^k neighbours is kept.  Inside a run of four periods two such windows lie exactly
one period apart and see the same words, so their minima repeat at that distance;
and no equal hash lies between them, since words as many as a period are equal
inside a run only at whole periods.  So neighbouring places of an equal minimizer,
at a distance that the scale answers for, seed every run of the scale: one pair
a place, not all pairs.  A seed is extended both ways at its distance by bisection
over prefix hashes, kept if it is long enough, and seeds of one run fall together.
A stretch found at several periods is a run of the least of them.

All of it works on a slice of a batch at a time, texts laid end to end; a word's
hash carries its text, so nothing is equal across texts.  Words count as equal
when their 64-bit hashes are.  Nothing is shuffled; memory is a small multiple of
the longest text.

Cases: null and empty texts have no words, no runs and an empty result text;
repeated rows get the same result each; ties for the strongest run go to the
smaller start, then the smaller period; an empty table gives an empty result;
columns other than the two named are ignored."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import common as C

LEAST, REPEATS, FIRST = 6, 4, 4


def _keep(start, end, period, least: int, repeats: int):
    ok = end - start >= np.maximum(least, repeats * period)
    return start[ok], end[ok], period[ok]


def scan(x: np.ndarray, lag: int, least: int, repeats: int):
    """Stretches of period ``lag``, by comparing each word with the one a lag on."""
    if len(x) <= lag:
        return (np.empty(0, np.int64),) * 3
    same = np.zeros(len(x) - lag + 2, bool)
    np.equal(x[lag:], x[:-lag], out=same[1:-1])
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, end = edge[::2], edge[1::2] + lag
    return _keep(start, end, np.full(len(start), lag), least, repeats)


def minimizers(v: np.ndarray, width: int) -> np.ndarray:
    """Places of ``v`` that are the minimum of some ``width`` neighbours."""
    low = C.sliding_min(v, width)
    pad = np.full(width - 1, np.iinfo(v.dtype).max, v.dtype)
    return np.flatnonzero(~C.sliding_min(np.r_[pad, ~low, pad], width) == v)


def seeds(x: np.ndarray, sums: np.ndarray, scale: int):
    """Neighbouring places of equal minimizers, and their distance."""
    low, span = 1 << scale, 2 << scale
    if len(x) < span + low:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    v = C.roll_hash(sums, span)
    at = minimizers(v, low)
    order = at[np.argsort(v[at], kind="stable")]
    far = order[1:] - order[:-1]
    hit = (v[order[1:]] == v[order[:-1]]) & (far >= low) & (far < span)
    return order[:-1][hit], far[hit]


def extend(x: np.ndarray, sums: np.ndarray, at: np.ndarray, lag: np.ndarray):
    """The maximal stretch around each place in which words a lag apart are equal."""
    def most(reach, start, end):
        lo, hi = np.zeros_like(reach), reach
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = C.span_hash(sums, start(mid), end(mid)) == C.span_hash(sums, start(mid) + lag, end(mid) + lag)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    ahead = most(len(x) - at - lag, lambda n: at, lambda n: at + n)
    back = most(at.copy(), lambda n: at - n, lambda n: at)
    return at - back, at + lag + ahead


def find_runs(x: np.ndarray, offs: np.ndarray, least: int = LEAST, repeats: int = REPEATS, first: int = FIRST):
    """(start, end, period) of all runs in the sequences x[offs[i]:offs[i + 1]],
    by start, then period.  ``repeats`` is 4 or more."""
    size = np.diff(offs)
    text = np.repeat(np.arange(len(size)), size)
    x = x ^ C.mix(text.astype(np.uint64) + np.uint64(1))
    found = [scan(x, lag, least, repeats) for lag in range(1, 1 << first)]
    scale, longest = first, int(size.max()) if len(size) else 0
    place = np.arange(len(x))
    while repeats << scale <= longest:
        stays = (size >= repeats << scale)[text]  # texts too short for the scale leave for good
        if not stays.all():
            x, text, place = x[stays], text[stays], place[stays]
        sums = C.prefix(x)
        at, lag = seeds(x, sums, scale)
        if len(at):
            start, end, lag = _keep(*extend(x, sums, at, lag), lag, least, repeats)
            found.append((place[start], place[end - 1] + 1, lag))
        scale += 1
    start, end, period = (np.concatenate(f).astype(np.int64) for f in zip(*found))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][:len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def repeated(n: int, start, end, period) -> np.ndarray:
    """Places that some run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:n]) > 0


def planted(ids: list, offs: np.ndarray) -> np.ndarray:
    """The word that stands at each place once documents chosen by a hash of
    their id repeat their tail: words from a on become original words
    a + (i - a) mod p.  A null id is not chosen."""
    source = np.arange(offs[-1])
    for k, d in enumerate(ids):
        n = int(offs[k + 1] - offs[k])
        h = zlib.crc32(str(d).encode())
        if d is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[offs[k] + a:offs[k + 1]] = offs[k] + a + np.arange(n - a) % p
    return source


_RUN = "doc_id long, start long, length long, period long"
_TEXT = "doc_id long, text string, n_dropped long"
_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _run(out: str, edit, least: int, repeats: int):
    def rows(batches):
        schema = _schema(out)
        for batch in batches:
            for part, data, offs in C.pieces(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                s, e, wo = C.words(data, offs)
                h = C.word_hashes(data, s, e)
                if edit is not None:
                    source = edit(ids, wo)
                    s, e, h = s[source], e[source], h[source]
                start, end, period = find_runs(h, wo, least, repeats)
                doc = np.searchsorted(wo, start, "right") - 1
                if out == _RUN:
                    yield C.record(schema, part.column("doc_id").take(pa.array(doc)), start - wo[doc], end - start, period)
                    continue
                drop = repeated(len(h), start, end, period)
                line, at = C.joined(data, s[~drop], e[~drop])
                kept = np.r_[0, np.cumsum(~drop)][wo]
                line, at = line.tobytes(), at[kept].tolist()
                texts = [line[a:b - 1] if b > a else b"" for a, b in zip(at, at[1:])]
                if out == _TEXT:
                    yield C.record(schema, part.column("doc_id"), [t.decode() for t in texts], np.diff(wo) - np.diff(kept))
                    continue
                yield C.record(schema, part.column("doc_id"), *_digest(len(ids), doc, start - wo[doc], end - start, period),
                               [hashlib.sha256(t).hexdigest() for t in texts])
    return rows


def _digest(n: int, doc, start, length, period):
    """Per text: runs, its strongest run, and a digest of all its runs."""
    count = np.bincount(doc, minlength=n)
    order = np.lexsort((period, start, -(length / period), doc))  # exact below 2^26 words
    lead = order[np.r_[True, doc[order][1:] != doc[order][:-1]][:len(order)]]
    best = np.full((4, n), -1, np.int64)
    best[:, doc[lead]] = start[lead], length[lead], period[lead], 1000 * length[lead] // period[lead]
    none = count == 0
    lines = [f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist())]
    ends = np.r_[0, np.cumsum(count)].tolist()
    sha = [hashlib.sha256("".join(lines[a:b]).encode()).hexdigest() for a, b in zip(ends, ends[1:])]
    return count, *(pa.array(b, mask=none) for b in best), sha


def _over(docs: DataFrame, out: str, text: str, doc_id: str, edit, least: int, repeats: int) -> DataFrame:
    if repeats < 4:
        raise ValueError("repeats must be 4 or more")
    texts = C.bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_run(out, edit, least, repeats), out)


def runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", edit=None, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """One row per run: doc_id, start (word number), length, period."""
    return _over(docs, _RUN, text, doc_id, edit, least, repeats)


def collapsed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", edit=None, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """doc_id, text with one period of each run left (words joined by one space), n_dropped."""
    return _over(docs, _TEXT, text, doc_id, edit, least, repeats)


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", edit=None, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """Per document: n_runs, the run with most periods, digests of all runs and of the collapsed text."""
    return _over(docs, _DIGEST, text, doc_id, edit, least, repeats)


def op12(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=planted)
