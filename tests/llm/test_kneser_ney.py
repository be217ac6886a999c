import math
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.conftest import SF_SMALL
from tests.llm import brute
from trapline.llm import common as C
from trapline.llm import kneser_ney as K

DOCS = "doc_id long, text string, lang string, quality string, p int"


def by_definition(texts):
    """Interpolated modified Kneser-Ney over dictionaries, nothing pruned."""
    seqs = [["<s>", "<s>", *brute.WORD.findall(t), "</s>"] for t in texts]
    c3 = Counter(g for s in seqs for g in zip(s, s[1:], s[2:]))
    c2 = Counter((v, w) for _, v, w in c3)
    c1 = Counter(w for _, w in c2)

    def order(c):
        n = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        d = K.discounts(*n)
        total, left = Counter(), Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            left[g[:-1]] += d[min(x, 3) - 1]
        return lambda g: max(c[g] - d[min(c[g], 3) - 1], 0) / total[g[:-1]] if c[g] else 0.0, lambda h: left[h] / total[h] if total[h] else 1.0
    a3, l3 = order(c3)
    a2, l2 = order(c2)
    a1, l1 = order(Counter({(w,): x for w, x in c1.items()}))
    return lambda u, v, w: a3((u, v, w)) + l3((u, v)) * (a2((v, w)) + l2((v,)) * (a1((w,)) + l1(()) / (len(c1) + 1)))


def test_model_matches_the_definition(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    some, rest = texts[:60], texts[60:90] + ["", "unseen words only"]
    p = by_definition(some)
    model = K.train(spark.createDataFrame([(t,) for t in some], "text string").repartition(3), least=1)
    for t in rest:
        tok, at = K.tokens(*C.buffers(pa.array([t])))
        got = K.probabilities(model, tok, K._places(at)[0])
        s = ["<s>", "<s>", *brute.WORD.findall(t), "</s>"]
        assert np.allclose(got, [p(*s[i - 2:i + 1]) for i in range(2, len(s))], rtol=1e-9)


def test_pruned_contexts_sum_to_one(spark):
    texts = ["a b a b c", "a b a c", "b a b c c a b a"] * 2 + ["c a"]
    model = K.train(spark.createDataFrame([(t,) for t in texts], "text string"), least=2)
    vocab = [C.word_hashes(*(lambda d, o: (d, *C.words(d, o)[:2]))(*C.buffers(pa.array([w]))))[0] for w in "abc"] + [K.END]
    for u in vocab[:3] + [K.START]:
        for v in vocab[:3] + [K.START]:
            tok = np.array([x for w in vocab for x in (u, v, w)] + [u, v, 12345], np.uint64)
            total = K.probabilities(model, tok, np.arange(2, len(tok), 3)).sum()
            assert math.isclose(total, 1, rel_tol=1e-9)


def test_held_out_accuracy_and_cases(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    r = np.random.default_rng(1)
    junk = [(10_000 + i, " ".join("".join(r.choice(list("xqzj0189#@"), 8)) for _ in range(120)), "en") for i in range(30)]
    odd = [(None, None, None), (20_000, "", "en"), (20_001, "one", None), (20_002, "word " * 30, "xx"), (20_002, "word " * 30, "xx")]
    df = docs.union(spark.createDataFrame(junk + odd, "doc_id long, text string, lang string")).withColumn("quality", K.F.lit("clash"))
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    got = {x.doc_id: x for x in K.classify(df, labels, sample=60).collect()}
    assert not any(got[10_000 + i].kept for i in range(30))
    good = {x.doc_id for x in labels.where("quality = 1 and toxic = 0").collect()}
    fresh = [got[d].kept for d in good if not got[d].trained]
    assert np.mean(fresh) >= 0.95
    assert not got[None].kept and got[None].perplexity is None and not got[20_000].kept and got[20_001].lang == ""
    assert K.classify(df.limit(0), labels).collect() == []
    none = K.classify(df, labels.limit(0)).where("doc_id = 0").collect()
    assert none[0].kept and none[0].threshold is None
