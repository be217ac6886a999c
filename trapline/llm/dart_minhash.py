"""MinHash near-dedup with DartMinHash.

A document is its shingles of five words (one shingle if it has fewer) with
their counts as weights; similarity is the weighted Jaccard index, the sum of
the lesser counts over the sum of the greater.

Sketch.  Darts fall on the plane of weight x rank of every shingle: the weight
axis is cut into regions [0,1), [1,2), [2,4), ..., each throws darts at its own
seeded rate, and a document owns the darts below its weight.  About
``k ln k + 2k`` of its darts lie under a rank bound of darts / total weight, so
heavy and long documents cost no more than their shingles plus that number.
Each dart belongs to one of k coordinates and the earliest dart of a coordinate
is its signature; two documents agree in a coordinate with a probability equal to their
similarity.  A coordinate that got no dart is sought again under twice the bound.

Join.  Bands of ``rows`` coordinates are the buckets.  Documents with equal
shingles collapse first.  Inside a bucket no pairs are formed: its members are
compared to three of them -- the one that meets most others over all its buckets
(the original of a group of copies), the one that meets fewest, and a random
one -- so the pairs number at most three per member, however hot the bucket is.
Every pair is held to the exact index of its whole shingle lists; links at
``threshold`` or more make components.  Buckets whose members lie in one
component are settled.  In the contested ones a prefix filter finds the components
that may be linked: shingles are ordered by the number of contested documents that
hold them, those held by one component only first, and two documents at
``threshold`` must share one of their earliest ``1 - threshold`` shares, at places
that leave room for enough others.  So components that have a frequent passage in
common, and nothing else, do not meet.  Two components that meet are compared by
their centres first; one less the index is a distance, so the triangle inequality
tells which members, if any, can still be near.  Those meet in blocks of bounded
size, not in pairs, and each yields its nearest neighbour there at most.  No two
components with a link in one bucket stay apart.

Cases: null text is empty; a document without words has no shingles and is a
class of its own; rows repeated whole fall in one class; a class is named by
its least doc_id (null if it has none); an empty table gives an empty result;
extra columns are ignored."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm import common as C
from trapline.llm.components import components
from trapline.session import materialize

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 4
BLOCK = 1 << 17  # bytes of shingle lists
_U = np.uint64


def shingles(data, offs, width: int = SHINGLE):
    """(document index, shingle hash, count), sorted by document and hash."""
    s, e, wo = C.words(data, offs)
    h = C.word_hashes(data, s, e)
    sums = C.prefix(h)
    n = np.diff(wo)
    m = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    doc = np.repeat(np.arange(len(n)), m)
    start = wo[:-1][doc] + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    x = C.span_hash(sums, start, start + np.minimum(n[doc], width))
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], x[at], np.diff(np.append(at, len(x)))


def _unit(x):
    return ((x >> _U(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def _throw(doc, x, weight, bound, k):
    """Darts under each document's rank bound: (document, coordinate, rank, dart)."""
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    i = np.repeat(np.arange(len(x)), levels)
    level = np.arange(len(i)) - np.repeat(np.cumsum(levels) - levels, levels)
    lo = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    wide = np.where(level == 0, 1.0, lo)
    seed = C.mix(x[i] + C.mix(level.astype(np.uint64) + _U(1)))
    rank, j, out = np.zeros(len(i)), 0, []
    doc, weight = doc[i], weight[i]
    limit = bound[doc]
    while len(doc):
        rank = rank - np.log(_unit(C.mix(seed + _U(4 * j)))) / wide
        live = rank <= limit
        doc, weight, limit, lo, wide, seed, rank = (a[live] for a in (doc, weight, limit, lo, wide, seed, rank))
        own = lo + wide * _unit(C.mix(seed + _U(4 * j + 1))) < weight
        out.append((doc[own], (C.mix(seed[own] + _U(4 * j + 2)) % _U(k)).astype(np.int64), rank[own], C.mix(seed[own] + _U(4 * j + 3))))
        j += 1
    return tuple(np.concatenate(a) for a in zip(*out)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0), np.empty(0, np.uint64))


def signatures(doc, x, weight, docs: int, k: int) -> np.ndarray:
    """k coordinates for each of ``docs`` documents (zeros if it has no weight)."""
    weight = weight.astype(np.float64)
    total = np.bincount(doc, weight, docs)
    sig = np.zeros((docs, k), np.uint64)
    todo, darts = total > 0, k * math.log(k) + 2 * k
    while todo.any():
        m = todo[doc]
        d, c, r, v = _throw(doc[m], x[m], weight[m], np.divide(darts, total, out=np.zeros(docs), where=total > 0), k)
        key = d * k + c
        order = np.lexsort((r, key))
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        got = np.bincount(key[first] // k, minlength=docs)
        full = todo & (got == k)
        keep = first & full[key // k]
        sig.ravel()[key[keep]] = v[order][keep]
        todo &= ~full
        darts *= 2
    return sig


_SKETCH = "did long, tkey long, doc_id long, fp long, total long, bands array<long>"
_SKETCH_PA = pa.schema([("did", pa.int64()), ("tkey", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()),
                        ("total", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sketches(width, bands, rows):
    def run(batches):
        for batch in batches:
            for part, data, offs in C.pieces(batch, "text", C.PIECE // 2):
                n = part.num_rows
                doc, x, c = shingles(data, offs, width)
                total = np.bincount(doc, c, n).astype(np.int64)
                fp = np.zeros(n, np.uint64)
                np.add.at(fp, doc, C.mix(x + C.mix(c.astype(np.uint64))))
                fp = C.mix(fp + total.astype(np.uint64))
                sig = signatures(doc, x, c, n, bands * rows).reshape(n, bands, rows)
                key = np.zeros((n, bands), np.uint64)
                for j in range(rows):
                    key = C.mix(key + sig[:, :, j])
                col = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(C.as_long(key.ravel())))
                yield C.record(_SKETCH_PA, part.column("did"), part.column("tkey"), part.column("doc_id"), C.as_long(fp), total, col)
    return run


_LIST = "fp long, body binary"
_LIST_PA = pa.schema([("fp", pa.int64()), ("body", pa.binary())])


def _lists(width):
    """Each document's shingles, the m-th occurrence of one as an element of its own."""
    def run(batches):
        for batch in batches:
            for part, data, offs in C.pieces(batch, "text"):
                n = part.num_rows
                doc, x, c = shingles(data, offs, width)
                i = np.repeat(np.arange(len(x)), c)
                nth = (np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64)
                el = C.mix(x[i] + C.mix(nth))
                cut = np.searchsorted(doc[i], np.arange(n + 1))
                body = pa.array([np.sort(el[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
                yield C.record(_LIST_PA, part.column("fp"), body)
    return run


def _distances(batches):
    """One less the index of each pair's shingle lists."""
    for batch in batches:
        a, b = batch.column("body_a"), batch.column("body_b")
        far = np.empty(batch.num_rows)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
            z = np.concatenate([x, y])
            z.sort(kind="stable")
            both = int((z[1:] == z[:-1]).sum())
            far[i] = 1 - both / (len(z) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far)], ["a", "b", "far"])


def _elements(batches):
    """A row for each element of the documents' lists."""
    for batch in batches:
        body = batch.column("body")
        for i in range(batch.num_rows):
            el = np.frombuffer(body[i].as_buffer(), np.int64)
            for at in range(0, len(el), C.PIECE // 8):
                part = el[at:at + C.PIECE // 8]
                fp, label = (pa.array(np.full(len(part), batch.column(c)[i].as_py(), np.int64)) for c in ("fp", "label"))
                yield pa.RecordBatch.from_arrays([fp, label, pa.array(np.full(len(part), len(el), np.int64)), pa.array(part)],
                                                 ["fp", "label", "total", "el"])


def _neighbours(contested: DataFrame, body: DataFrame, threshold: float) -> DataFrame:
    """Pairs of components (lo, hi) that may have a link in one bucket, by the
    prefix filter over their members: a row per component, bucket and early
    shingle, however many members hold it."""
    label = contested.select("fp", "label").distinct()
    els = materialize(body.join(label, "fp").mapInArrow(_elements, "fp long, label long, total long, el long"), "elements")
    shared = els.groupBy("el").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    doc = Window.partitionBy("fp")
    rank = F.col("total") - F.count("*").over(doc) + F.row_number().over(doc.orderBy("df", "el"))
    early = els.join(shared.select("el", "df"), "el").select("fp", "total", "el", rank.alias("rank"))
    early = early.where(F.col("rank") <= F.col("total") - F.ceil(F.col("total") * threshold - 1e-6) + 1)
    held = early.join(contested.select("fp", "label", "bucket"), "fp").groupBy("bucket", "el", "label").agg(
        F.min("total").alias("short"), F.max("total").alias("long"), F.max(F.col("total") - F.col("rank")).alias("room"))
    rows = materialize(held, "prefixes")
    x, y = rows.alias("x"), rows.alias("y")
    pairs = x.join(y, F.expr("x.bucket = y.bucket AND x.el = y.el AND x.label < y.label")
                   & (F.least("x.room", "y.room") + 1 >= (F.col("x.short") + F.col("y.short")) * (threshold / (1 + threshold)) - 1e-6)
                   & (F.least("x.long", "y.long") >= F.greatest("x.short", "y.short") * threshold - 1e-6))
    return pairs.select(F.col("x.label").alias("lo"), F.col("y.label").alias("hi")).distinct()


def _across(contested: DataFrame, body: DataFrame, threshold: float, measured) -> list[DataFrame]:
    """Links (a, b) that join every two components with a link in one bucket.
    One less the index is a distance, so the triangle inequality settles most by
    few members: centre to centre, then the members of the smaller component to
    the larger one's centre, and only then the members that may still be near."""
    most = 1 - threshold + 1e-9
    near = materialize(_neighbours(contested, body, threshold), "neighbours")
    member = materialize(contested.groupBy("fp", "label").agg(F.max("meets").alias("meets")).join(
        near.select(F.explode(F.array("lo", "hi")).alias("label")).distinct(), "label"), "members")
    centre = member.groupBy("label").agg(F.max(F.struct("meets", "fp"))["fp"].alias("centre"), F.count("*").alias("n"))
    reach = measured(member.join(centre, "label").where("fp <> centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")), body)
    member = materialize(member.join(reach.select(F.col("a").alias("fp"), "far"), "fp", "left").select("fp", "label", F.coalesce("far", F.lit(0.0)).alias("far")), "members")
    centre = materialize(centre.join(member.groupBy("label").agg(F.max("far").alias("radius")), "label"), "centres")
    two = (near.join(centre.select(*[F.col(c).alias(f"{c}_lo") for c in centre.columns]), F.col("lo") == F.col("label_lo"))
           .join(centre.select(*[F.col(c).alias(f"{c}_hi") for c in centre.columns]), F.col("hi") == F.col("label_hi")))
    swap = F.col("n_lo") > F.col("n_hi")
    side = lambda c, big: F.when(swap, F.col(f"{c}_{'lo' if big else 'hi'}")).otherwise(F.col(f"{c}_{'hi' if big else 'lo'}"))
    two = materialize(two.select(*[side(c, b).alias(f"{c}_{'big' if b else 'small'}") for c in ("label", "centre", "radius") for b in (True, False)]), "neighbours")
    first = measured(two.select(F.col("centre_small").alias("a"), F.col("centre_big").alias("b")), body)
    open_ = two.join(first.select(F.col("a").alias("centre_small"), F.col("b").alias("centre_big"), "far"), ["centre_small", "centre_big"])
    open_ = open_.where((F.col("far") > most) & (F.col("far") <= F.col("radius_small") + F.col("radius_big") + most)).drop("far")
    small = member.select(F.col("fp").alias("a"), F.col("label").alias("label_small"))
    asked = materialize(open_.join(small, "label_small").select("a", F.col("centre_big").alias("b"), "label_small", "label_big", "radius_big"), "asked")
    second = measured(asked.select("a", "b").distinct(), body)
    asked = asked.join(second, ["a", "b"])
    linked = asked.where(F.col("far") <= most).select("label_small", "label_big").distinct()
    left = asked.where(F.col("far") <= F.col("radius_big") + most).join(linked, ["label_small", "label_big"], "left_anti")
    left = left.groupBy(F.col("label_big").alias("label"), F.col("a").alias("fp")).agg(F.min("far").alias("far"))
    big = member.join(left.select("label").distinct(), "label", "left_semi")
    x, y = _blocks(left, body, "xs"), _blocks(big, body, "ys")
    third = materialize(x.join(y, "label").select("xs", "ys").mapInArrow(_nearest(most), "a long, b long"), "nearest")
    return [d.where(F.col("far") <= most).select("a", "b") for d in (first, second)] + [third]


def _blocks(rows: DataFrame, body: DataFrame, name: str) -> DataFrame:
    """(label, list of fp, far, body): the rows of a label in blocks of about BLOCK bytes, by hash."""
    full = rows.select("label", "fp", "far").join(body, "fp")
    parts = full.groupBy("label").agg(F.ceil(F.sum(F.length("body") + 16) / BLOCK).alias("parts"))
    full = full.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    return full.groupBy("label", "part").agg(F.collect_list(F.struct("fp", "far", "body")).alias(name)).drop("part")


def _nearest(most: float):
    """For each of a block's documents the nearest of another block's, if it is a
    link; those that the distances to a common centre keep apart are passed over."""
    def run(batches):
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                xs, ys = batch.column("xs")[i].values, batch.column("ys")[i].values
                size = np.array([len(v.as_buffer()) // 8 for v in ys.field("body")])
                flat = np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in ys.field("body")])
                at, own, fps = np.cumsum(size) - size, ys.field("far").to_numpy(), ys.field("fp").to_pylist()
                for fp, far, v in zip(xs.field("fp").to_pylist(), xs.field("far").to_pylist(), xs.field("body")):
                    mine = np.frombuffer(v.as_buffer(), np.uint64)
                    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    both = np.add.reduceat(hit, at, dtype=np.int64)
                    gap = np.where(own >= far - most, 1 - both / (size + len(mine) - both), 2.0)
                    k = int(np.argmin(gap))
                    if gap[k] <= most:
                        a.append(fp)
                        b.append(fps[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _stars(buckets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of each bucket's members with its three centres, once each."""
    centre = buckets.groupBy("band", "key").agg(
        F.max(F.struct("meets", "fp", "total")).alias("most"), F.min(F.struct("meets", "fp", "total")).alias("least"),
        F.min(F.struct(F.xxhash64("fp", "band").alias("meets"), "fp", "total")).alias("any")).where("most.fp <> least.fp")
    rows = buckets.join(centre, ["band", "key"])
    rows = rows.select("fp", "total", F.explode(F.array("most", "least", "any")).alias("c")).where("fp <> c.fp")
    near = F.least("total", "c.total") >= threshold * F.greatest("total", "c.total")
    return rows.where(near).select(F.least("fp", "c.fp").alias("a"), F.greatest("fp", "c.fp").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, bands: int = BANDS,
            rows: int = ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: did, tkey (its key, see ``common.keyed``), doc_id,
    class_id, class_size, first (the class's first document, by key)."""
    source = C.keyed(docs, text, doc_id)
    sketch = materialize(source.mapInArrow(_sketches(width, bands, rows), _SKETCH), "sketches")
    nodes = sketch.where("total > 0").groupBy("fp").agg(F.min(F.struct("did", "tkey")).alias("at"))
    bucket = (sketch.where("total > 0").select("fp", "total", F.posexplode("bands").alias("band", "key")).distinct())
    met = bucket.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    bucket = materialize(bucket.join(met, ["band", "key"]), "buckets")
    meets = bucket.groupBy("fp").agg(F.sum("size").alias("meets"))
    bucket = materialize(bucket.drop("size").join(meets, "fp"), "buckets")

    def lists(fps: DataFrame) -> DataFrame:
        where = nodes.join(fps.distinct(), "fp").select("fp", "at.did", "at.tkey").alias("w")
        return materialize(source.join(where, ["did", "tkey"]).select("fp", "text").dropDuplicates(["fp"])
                           .mapInArrow(_lists(width), _LIST), "shingles")

    def measured(pairs: DataFrame, body: DataFrame) -> DataFrame:
        full = (pairs.join(body.select(F.col("fp").alias("a"), F.col("body").alias("body_a")), "a")
                .join(body.select(F.col("fp").alias("b"), F.col("body").alias("body_b")), "b"))
        return materialize(full.mapInArrow(_distances, "a long, b long, far double"), "distances")

    pairs = materialize(_stars(bucket, threshold), "pairs")
    links = measured(pairs, lists(pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp")))))
    links = links.where(F.col("far") <= 1 - threshold + 1e-9).select("a", "b")
    label = components(links)
    member = bucket.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    mixed = member.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    contested = materialize(member.join(mixed.select("band", "key"), ["band", "key"])
                            .select("fp", "label", "meets", F.xxhash64("band", "key").alias("bucket")), "contested")
    more = _across(contested, lists(contested.select("fp")), threshold, measured)
    if any(m.limit(1).count() for m in more):
        label = components(functools.reduce(DataFrame.union, more, links))
    single = F.when(F.col("total") == 0, F.xxhash64("did", "tkey", F.lit("no words"))).otherwise(F.coalesce("label", "fp"))
    named = materialize(sketch.select("did", "tkey", "doc_id", "fp", "total").join(label.withColumnRenamed("node", "fp"), "fp", "left")
                        .select("did", "tkey", "doc_id", single.alias("cls")), "classes")
    size = named.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"),
                                    F.min(F.struct("did", "tkey")).alias("head"))
    return (named.join(size, "cls").select("did", "tkey", "doc_id", "class_id", "class_size",
                                           (F.struct("did", "tkey") == F.col("head")).alias("first")))


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The first document of each class, with its columns; rows repeated whole
    stay once."""
    head = classes(docs, text=text, doc_id=doc_id, **settings).where("first").select("did", "tkey").distinct()
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("did"),
                       F.xxhash64(F.col(doc_id).cast("long"), t).alias("tkey"))
    return rows.join(head, ["did", "tkey"]).dropDuplicates(["did", "tkey"]).select("row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select("doc_id", "class_id", "class_size")
