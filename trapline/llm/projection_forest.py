"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample of distinct vectors (``sample`` of
them, chosen by hash): each inner node splits its sample at the median of the
projection on the difference of two random members.  Every row is then indexed:
it goes down all trees to one leaf each.  A query searches all trees through one
priority queue (a branch is worth the least margin on its way) and takes leaves
until they hold ``search`` times as many rows as the table, counted over all
trees.  Leaves and the queries that took them meet by a co-grouped join on
(tree, leaf), large leaves and large sets of queries dealt in blocks; in a block
the candidates are ranked by their exact inner products in double precision, and
only the best of each query leave it.  Equal vectors are searched once and stand
for their least ids, which is all that ties can ask for.

``search`` is a share because vectors without structure leave a tree little to
prune; clustered vectors reach the same recall with far less.

Cases: vectors that are null, zero, or hold null or non-finite components take
no part; vectors are compared only to those of their own length; fewer than
``top`` candidates are all returned; rows repeated whole count once; null ids
take no part; an empty table gives an empty result."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm import common as C
from trapline.session import materialize

TREES, SAMPLE, LEAF, SEARCH, TOP = 8, 4096, 96, 2.0, 20
BLOCK, QUERIES = 8192, 4096


class Forest:
    """Trees as lists of nodes (normal, split, left, right); a leaf is (None, number, 0, 0)."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.trees, self.leaves = [], []
        for _ in range(trees):
            nodes, count = [], 0
            todo = [(np.arange(len(sample)), -1, 0)]
            while todo:
                idx, parent, side = todo.pop()
                at = len(nodes)
                if parent >= 0:
                    nodes[parent][2 + side] = at
                cut = None
                if len(idx) > leaf:
                    a, b = sample[r.choice(idx, 2, replace=False)]
                    p = sample[idx] @ (a - b)
                    m = float(np.median(p))
                    if (p <= m).any() and (p > m).any():
                        cut = (a - b) / np.linalg.norm(a - b), m / np.linalg.norm(a - b), p <= m
                if cut is None:
                    nodes.append([None, count, 0, 0])
                    count += 1
                else:
                    nodes.append([cut[0], cut[1], 0, 0])
                    todo += [(idx[cut[2]], at, 0), (idx[~cut[2]], at, 1)]
            self.trees.append(nodes)
            self.leaves.append(count)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.trees)), np.int32)
        for t, nodes in enumerate(self.trees):
            todo = [(0, np.arange(len(x)))]
            while todo:
                at, rows = todo.pop()
                w, m, left, right = nodes[at]
                if w is None:
                    out[rows, t] = m
                elif len(rows):
                    down = x[rows] @ w <= m
                    todo += [(left, rows[down]), (right, rows[~down])]
        return out

    def search(self, q: np.ndarray, sizes: list[list[int]], want: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue until ``want`` rows are held."""
        queue = [(-np.inf, t, 0) for t in range(len(self.trees))]
        out, held = [], 0
        while queue and held < want:
            worth, t, at = heapq.heappop(queue)
            w, m, left, right = self.trees[t][at]
            if w is None:
                if sizes[t][m]:
                    out.append((t, m))
                    held += sizes[t][m]
                continue
            d = float(q @ w) - m
            heapq.heappush(queue, (max(worth, d), t, left))
            heapq.heappush(queue, (max(worth, -d), t, right))
        return out


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _placed(forests):
    schema = pa.schema([("dim", pa.int32()), ("tree", pa.int32()), ("leaf", pa.int32()), ("part", pa.int32()), ("vh", pa.int64()),
                        ("v", pa.list_(pa.float64()))])

    def rows(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                forest = forests.value[int(dim)]
                leaf = forest.place(_matrix(some.column("v")))
                n = some.num_rows
                for t in range(leaf.shape[1]):
                    yield C.record(schema, np.full(n, dim, np.int32), np.full(n, t, np.int32), leaf[:, t], some.column("part"),
                                   some.column("vh"), some.column("v"))
    return rows


def _searched(forests, sizes, wants, parts):
    schema = pa.schema([("dim", pa.int32()), ("tree", pa.int32()), ("leaf", pa.int32()), ("part", pa.int32()), ("qpart", pa.int32()),
                        ("qh", pa.int64()), ("q", pa.list_(pa.float64()))])

    def rows(batches):
        for batch in batches:
            for one in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                take, at = [], []
                dims = one.column("dim").to_pylist()
                for i, v in enumerate(one.column("v").to_pylist()):
                    d = dims[i]
                    got = forests.value[d].search(np.array(v), sizes.value[d], wants[d])
                    take += [(d, t, leaf, p) for t, leaf in got for p in range(parts[d])]
                    at += [i] * len(got) * parts[d]
                if take:
                    keys = np.array(take, np.int32)
                    at = pa.array(at)
                    yield C.record(schema, *keys.T, one.column("qpart").take(at), one.column("vh").take(at), one.column("v").take(at))
    return rows


def _ranked(top):
    def block(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table({"qh": pa.array([], pa.int64()), "vh": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, q = _matrix(rows.column("v").combine_chunks()), _matrix(queries.column("q").combine_chunks())
        vh, qh = rows.column("vh").to_numpy(), queries.column("qh").to_numpy()
        found = []
        for i in range(0, len(q), 256):
            s = q[i:i + 256] @ x.T
            k = min(top + 1, s.shape[1])
            worst = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            a, b = np.nonzero(s >= (worst - 1e-12 * (1 + np.abs(worst)))[:, None])
            found.append(np.stack([a + i, b]))
        a, b = np.concatenate(found, axis=1)
        score = np.concatenate([(q[a[i:i + 65536]] * x[b[i:i + 65536]]).sum(axis=1) for i in range(0, len(a), 65536)])
        return pa.table({"qh": qh[a], "vh": vh[b], "score": score})
    return block


def search(vectors: DataFrame, is_query, top: int = TOP, share: float = SEARCH, trees: int = TREES, sample: int = SAMPLE,
           leaf: int = LEAF, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """The nearest ``top`` of each row for which ``is_query`` (a column of vec_id)
    holds, its own row left out: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    v = F.col("v")
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    source = (source.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(F.coalesce(sound, F.lit(False)))
              .select("vec_id", F.transform(v, lambda x: x + 0.0).alias("v"))  # -0.0 and 0.0 hash alike
              .withColumn("vh", F.xxhash64("v")).withColumn("dim", F.size("v")))
    source = materialize(source, "vectors")
    nearest = Window.partitionBy("vh").orderBy("vec_id")
    least = source.select("vh", "vec_id").distinct().withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= top + 1)
    ids = least.groupBy("vh").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = materialize(source.select("vh", "dim", "v").dropDuplicates(["vh"]), "distinct")
    counts = {r.dim: r.n for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per vector length
    built = {}
    for dim, n in counts.items():
        rows = distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("vh"), "vh").limit(sample).toArrow()
        built[dim] = Forest(_matrix(rows.column("v").combine_chunks()), trees, leaf)
    forests = spark.sparkContext.broadcast(built)
    parts = {d: max(1, -(-n * 2 // (max(built[d].leaves) * block))) for d, n in counts.items()}
    pick = lambda by, name: F.pmod(F.xxhash64("vh", F.lit(name)), by).cast("int")
    by_dim = F.coalesce(*[F.when(F.col("dim") == d, F.lit(p)) for d, p in parts.items()], F.lit(1)) if parts else F.lit(1)
    index = materialize(distinct.select("dim", pick(by_dim, "part").alias("part"), "vh", "v")
                        .mapInArrow(_placed(forests), "dim int, tree int, leaf int, part int, vh long, v array<double>"), "index")
    sizes = {d: [[0] * n for n in f.leaves] for d, f in built.items()}
    for r in index.groupBy("dim", "tree", "leaf").agg(F.count("*").alias("n")).collect():  # one row per leaf of the sample's trees
        sizes[r.dim][r.tree][r.leaf] = r.n
    asked = source.where(is_query(F.col("vec_id"))).select("vec_id", "vh").distinct()
    once = distinct.join(asked.select("vh").distinct(), "vh", "left_semi")
    qparts = max(1, -(-asked.count() // queries))
    wants = {d: share * n for d, n in counts.items()}
    taken = (once.select("dim", pick(F.lit(qparts), "query").alias("qpart"), "vh", "v").repartition("vh")
             .mapInArrow(_searched(forests, spark.sparkContext.broadcast(sizes), wants, parts),
                         "dim int, tree int, leaf int, part int, qpart int, qh long, q array<double>"))
    index = index.withColumn("qpart", F.explode(F.sequence(F.lit(0), F.lit(qparts - 1)).cast("array<int>")))
    cell = ["dim", "tree", "leaf", "part", "qpart"]
    found = (index.groupBy(*cell).cogroup(taken.groupBy(*cell)).applyInArrow(_ranked(top), "qh long, vh long, score double")
             .groupBy("qh", "vh").agg(F.max("score").alias("score")).join(ids, "vh"))
    best = Window.partitionBy("qh").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top + 1)
    every = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id")))))
    found = found.groupBy("qh").agg(F.slice(F.sort_array(every), 1, top + 1).alias("near"))
    return (asked.withColumnRenamed("vec_id", "query_id").join(found, F.col("vh") == F.col("qh"))
            .select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, top)).alias("k", "x"))
            .select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score")))


def op2(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
