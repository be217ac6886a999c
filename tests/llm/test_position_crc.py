import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from tests.conftest import SF_SMALL
from trapline.llm import position_crc as P

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(0x41, 0x5B)})


def feats(text, most):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i:i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, most=1, buckets=10_000, percent=10, least=20):
    """Rows (doc_id, text) -> (doc_id, n_features, weight, score, rank), CRC by zlib."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for x in side for f in feats(x, most)[1]) for side in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for d, x in rows:
        w, f = feats(x, most)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in map(of, f))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in out], key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()], key=str)


def test_crc_of_spans_of_all_lengths():
    r = random.Random(5)
    spans = [r.randbytes(n) for n in (*range(1, 3 * P.REACH + 2), 1000, 4096, 4097, 300_001)] * 2
    r.shuffle(spans)
    data, end = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(x) for x in spans])
    assert P.tables().crc32(data, end - [len(x) for x in spans], end).tolist() == [zlib.crc32(x) for x in spans]


def test_query_matches_brute_force_and_sql(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    have = got(P.op11(spark, SF_SMALL))
    assert have == brute(rows, target)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as from '{SF_SMALL}/{t}.parquet'")
    sql = con.sql(f"select doc_id, n_features, weight, score, rank from ({P.oracle()})").fetchall()
    assert sorted(sql, key=str) == have


def test_runs_of_words_odd_texts_ties_and_repeats(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["Alpha", "beta", "ÉTÉ", "x1", "日本", "ß", "a-b"]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    rows += [(-1, None), (-2, ""), (-3, "\x00 ~~ \x7f"), (None, "beta " * 25), (7, rows[7][1]), (7, rows[7][1]), (-4, "é" * 700_000 + " beta" * 30),
             (-5, "w " * 200_000), (-6, "Beta[gamma`delta{eps 0/9:8")]
    target = ["beta beta ÉTÉ", None, "", "x1 x1 alpha"]
    docs = spark.createDataFrame([(d, t, "clash", 1.0) for d, t in rows], "doc_id long, text string, weight string, rank double").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for most, buckets in ((1, 10_000), (3, 50)):
        have = got(P.drawn(P.weighted(docs, goal, buckets=buckets, max_words=most)))
        assert have == brute(rows, target, most, buckets)
    assert P.resampled(docs, goal).columns == docs.columns
    want = {x[0] for x in brute(rows, target) if x[4]}
    assert {x.doc_id for x in P.resampled(docs, goal).collect()} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    none = docs.limit(0)
    assert got(P.drawn(P.weighted(none, docs))) == []
    assert got(P.drawn(P.weighted(docs, none), percent=100)) == brute([(1, "a b " * 20)], [], percent=100)


def test_draw_is_even_over_ranges(spark):
    """Ranks are 1..k whatever the number of ranges, hot scores included."""
    w = spark.range(3000).selectExpr("id as doc_id", "cast(if(id % 3 = 0, 5, 40) as long) as n_words", "n_words as n_features", "cast(if(id % 2 = 0, 0, id) as long) as weight")
    out = P.drawn(w, percent=50).collect()
    able = sorted((r for r in out if r.n_words >= 20), key=lambda r: (-r.score, r.doc_id))
    assert [r.rank for r in able] == [k + 1 if k < len(able) // 2 else None for k in range(len(able))]
    assert all(r.rank is None for r in out if r.n_words < 20)
