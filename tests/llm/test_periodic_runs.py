import random
import zlib

import numpy as np

from tests.conftest import SF_SMALL
from tests.llm.brute import WORD, sha
from trapline.llm import common as C
from trapline.llm import periodic_runs as R


def runs(w):
    """By definition: maximal stretches for each lag whose smallest period is the lag."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                s = w[i:j + q]
                if not any(s[p:] == s[:-p] for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda t: (t[0], t[2]))


def brute(d, text, plant=True):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(d).encode())
    if plant and d is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = runs(w)
    drop = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda t: (-np.float64(t[1]) / t[2], t[0], t[2]), default=None)
    return (d, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_match_the_definition():
    r = random.Random(3)
    seqs = []
    for _ in range(300):
        k = r.choice([1, 2, 3, 40])
        w = [r.randrange(k) for _ in range(r.randint(0, 500))]
        for _ in range(r.randint(0, 3)):  # periods nested in periods
            if len(w) > 20:
                a = r.randrange(len(w))
                p = r.randint(1, max(1, (len(w) - a) // 3))
                for i in range(a, min(len(w), a + r.randint(3, 7) * p)):
                    w[i] = w[a + (i - a) % p]
        seqs.append(w)
    offs = np.r_[0, np.cumsum([len(w) for w in seqs])]
    x = C.mix(np.array([v for w in seqs for v in w], np.uint64) + np.uint64(1))
    want = sorted((a + int(o), a + int(o) + k, q) for w, o in zip(seqs, offs) for a, k, q in runs(w))
    for first in (1, 2, 4):  # the more scales, the fewer direct scans
        got = list(zip(*(v.tolist() for v in R.find_runs(x, offs, first=first))))
        assert sorted(got) == want, first
    assert max(q for *_, q in want) > 60


def test_long_periods():
    r = np.random.default_rng(4)
    for q in (1000, 1023, 1024, 5000):
        base = C.mix(r.integers(0, 1 << 40, q).astype(np.uint64))
        x = np.concatenate([C.mix(r.integers(1 << 41, 1 << 42, 777).astype(np.uint64)), np.tile(base, 5)[:4 * q + 3]])
        got = [v.tolist() for v in R.find_runs(x, np.array([0, len(x)]))]
        assert got == [[777], [777 + 4 * q + 3], [q]]
        short = x[:777 + 4 * q - 1]
        assert R.find_runs(short, np.array([0, len(short)]))[0].tolist() == []


def test_query_matches_the_definition(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((brute(d, t) for d, t in rows), key=str)
    got = sorted((tuple(r) for r in R.op12(spark, SF_SMALL).collect()), key=str)
    assert got == want
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_texts_repeats_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c " * 5), (4, "a b c " * 5), (None, "x y " * 9), (5, "ab " * 6), (6, "ab " * 5), (7, "é\x0bé\x0cé\ré\né é\té"),
            (8, "one two " * 30_000 + "end"), (9, "q" * 1_000_000), (10, "\x1c \x85 " * 4), (11, "m n m n m n m n o o o o o o o m n m n m n m n")]
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, period int, n_runs int").repartition(3)
    want = sorted((brute(d, t, plant=False) for d, t in rows if d != 8), key=str)
    got = {8: None}
    have = sorted((tuple(r) for r in R.digests(docs).collect()), key=str)
    assert [h for h in have if h[0] != 8] == want
    assert [h[1:6] for h in have if h[0] == 8] == [(1, 0, 60_000, 2, 30_000_000)]
    got = {(r.doc_id, r.start, r.length, r.period) for r in R.runs(docs).collect()}
    assert {(5, 0, 6, 1), (8, 0, 60_000, 2)} <= got and not any(d == 6 for d, *_ in got)
    text = {r.doc_id: (r.text, r.n_dropped) for r in R.collapsed(docs).collect()}
    assert text[4] == ("a b c", 12) and text[8] == ("one two end", 59_998) and text[1] == ("", 0)
    assert R.digests(docs.limit(0)).collect() == []
