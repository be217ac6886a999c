import math
import re
import zlib
from collections import Counter

import numpy as np

from tests.conftest import SF_SMALL
from trapline.llm import backoff_automaton as B

SCHEMA = "doc_id long, text string, h string, c int"


def toks(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def model(train, n, word_least, gram_least):
    """p(word | up to two before) by the definition, over dictionaries."""
    c1, c2, c3 = Counter(), Counter(), Counter()
    for t in train:
        c1.update(t)
    kept = {w for w, c in c1.items() if c >= word_least}
    den = n + 0.5 * (len(c1) + 1)
    for t in train:
        x = ["<s>", *t]
        c2.update(p for p in zip(x, x[1:]) if (p[0] in kept or p[0] == "<s>") and p[1] in kept)
    c2 = {p: c for p, c in c2.items() if c >= gram_least}
    for t in train:
        x = ["<s>", *t]
        c3.update(p for p in zip(x, x[1:], x[2:]) if p[:2] in c2 and p[1:] in c2)
    c3 = {p: c for p, c in c3.items() if c >= gram_least}
    one = lambda w: (c1[w] + 0.5) / den
    two = {p: (c - B.DISCOUNT) / (c1[p[0]] if p[0] != "<s>" else len(train)) for p, c in c2.items()}
    three = {p: (c - B.DISCOUNT) / c2[p[:2]] for p, c in c3.items()}
    after2, after3 = {}, {}
    for v, w in two:
        after2.setdefault(v, []).append(w)
    for u, v, w in three:
        after3.setdefault((u, v), []).append(w)

    def p2(v, w):
        if (v, w) in two:
            return two[v, w]
        a = after2.get(v, [])
        return one(w) * (1 - sum(two[v, x] for x in a)) / (1 - sum(map(one, a)))

    def p3(u, v, w):
        if (u, v, w) in three:
            return three[u, v, w]
        a = after3.get((u, v), [])
        return p2(v, w) * (1 - sum(three[u, v, x] for x in a)) / (1 - sum(two[v, x] for x in a))
    return one, p3, c1, kept


def test_scores_match_the_definition(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    docs += [(-1, None), (-2, ""), (-3, "The Of AND"), (-4, "ÀÉ zzz zzz"), (7, docs[7][1])]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3)
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    train = [toks(t) for d, t in docs if not held[d]]
    n = sum(map(len, train))
    one, p3, c1, _ = model(train, n, 1e-4 * n, 2)
    got = {}
    for r in B.score_documents(df, word_share=1e-4, gram_share=1e-6).collect():
        got.setdefault(r.doc_id, r)
    for d, t in docs:
        x, r = toks(t), got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(x), sum(w in c1 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10(one(w)) for w in x), rel_tol=1e-9)
        y = ["<none>", "<s>", *x]
        want = sum(math.log10(p3(*y[i:i + 3])) for i in range(len(x)))
        assert math.isclose(r.score, want, rel_tol=1e-8), d
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # better than single words on unseen text


def test_probabilities_sum_to_one():
    """Three words (numbers 0 to 2) of counts 10, 6, 4 and an unknown one (3); five texts."""
    count, n, v, d = np.array([10, 6, 4, 5]), 21, 4, B.DISCOUNT
    den = n + 0.5 * (v + 1)
    one = np.r_[(count[:3] + 0.5) / den, 0.5 / den]
    pairs = {(0, 1): 5, (0, 2): 2, (1, 0): 4, (4, 0): 3}
    triples = {(0, 1, 0): 3, (4, 0, 1): 2}
    at = {p: i for i, p in enumerate(pairs)}
    two = {p: (c - d) / (count[p[0]] if p[0] < 4 else 5) for p, c in pairs.items()}
    three = {t: (c - d) / pairs[t[:2]] for t, c in triples.items()}

    def back(high, low):
        return math.log10((1 - sum(high)) / (1 - sum(low))) if high else math.nan
    word_back = [back([two[p] for p in pairs if p[0] == x], [one[p[1]] for p in pairs if p[0] == x]) for x in range(5)]
    pair_back = [back([three[t] for t in triples if t[:2] == p], [two[t[1:]] for t in triples if t[:2] == p]) for p in pairs]
    arr = lambda x: np.array(list(x))
    a = B.Automaton(np.log10(one), arr(word_back), arr(p[0] for p in pairs), arr(p[1] for p in pairs), np.log10(arr(two.values())), arr(pair_back),
                    arr(at[t[:2]] for t in triples), arr(at[t[1:]] for t in triples), arr(t[2] for t in triples), np.log10(arr(three.values())))
    rest = (1 - one[:3].sum()) / one[3]   # what the unknown word stands for
    for history in ([], [0], [1], [0, 1], [0, 0], [2], [1, 0, 2], [3, 0]):
        begin = a.walk(history)
        total = sum(10 ** (a.walk(history + [w]) - begin) for w in range(3)) + 10 ** (a.walk(history + [3]) - begin) * rest
        assert abs(total - 1) < 1e-9, history


def test_blocks_rounds_and_cache_do_not_change_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").repartition(3)
    key = lambda r: (r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6))
    whole = sorted(map(key, B.score_documents(docs).collect()))
    monkeypatch.setattr(B, "BLOCK", 30_000)
    monkeypatch.setattr(B, "ROUNDS", 2)
    assert sorted(map(key, B.score_documents(docs, cached=500).collect())) == whole


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert B.score_documents(df).collect() == []
    only = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    r = B.score_documents(spark.createDataFrame([(only, "a b", "x", 1)], SCHEMA)).collect()[0]
    assert (r.n_known, r.train_tokens, r.n_tokens) == (0, 0, 3) and math.isclose(r.score, 3 * math.log10(0.5 / 0.5), abs_tol=1e-12)


def test_pair_seen_twice_stays_in_a_large_corpus(spark):
    """Rare n-grams are in the model however many tokens there are."""
    train = [d for d in range(400) if zlib.crc32(str(d).encode()) % 5 != 1]
    rows = [(d, "so it goes " * 1400, "x", 1) for d in train]   # over a million tokens
    for d in train[:2]:
        rows[train.index(d)] = (d, "rare mint leaf " + "so it goes " * 1400, "x", 1)
    held = next(d for d in range(400) if d not in train)
    rows.append((held, "a rare mint leaf", "x", 1))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    texts = [toks(t) for d, t, *_ in rows if d != held]
    n = sum(map(len, texts))
    assert 2e-6 * n > 2
    one, p3, _, _ = model(texts, n, 0, B.LEAST)
    y = ["<none>", "<s>", *toks("a rare mint leaf")]
    want = sum(math.log10(p3(*y[i:i + 3])) for i in range(len(y) - 2))
    got = B.score_documents(docs).where(f"doc_id = {held}").first()
    assert math.isclose(got.score, want, rel_tol=1e-8)
