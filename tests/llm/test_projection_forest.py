import numpy as np
import pytest

from tests.conftest import SF_SMALL
from trapline.llm import projection_forest as P

SCHEMA = "vec_id long, embedding array<float>, vh string, part int"


def brute(rows, top):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            s = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [(i, -x) for x, i in s[:top]]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got = out.setdefault(r.query_id, [])
        got.append((r.vec_id, r.score))
        assert r["rank"] == len(got)
    return out


@pytest.mark.parametrize("block", [8192, 16])
def test_whole_search_is_exact(spark, block):
    r = np.random.default_rng(1)
    v = lambda d=8: [float(x) for x in r.integers(-3, 4, d)]
    rows = [(i, v()) for i in range(300)]
    same = v()
    rows += [(1000 + i, same) for i in range(60)] + [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None]), (2060, [float("nan")] * 8),
                                                     (2080, [1.0, 2.0]), (2081, [2.0, 1.0]), (None, v()), (2100, []), rows[0], (2120, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, x, "x", 1) for i, x in rows], SCHEMA).repartition(3)
    got = collected(P.search(df, lambda i: i % 20 == 0, share=1e9, leaf=20, block=block, queries=block))
    want = {q: n for q, n in brute(rows, 20).items() if n}
    assert got == want


def test_recall(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = collected(P.op2(spark, SF_SMALL))
    hits = [len({i for i, _ in got[q]} & {i for i, _ in n}) / len(n) for q, n in want.items()]
    assert np.mean(hits) >= 0.9


def test_empty(spark):
    assert P.search(spark.createDataFrame([], SCHEMA), lambda i: i % 20 == 0).collect() == []
