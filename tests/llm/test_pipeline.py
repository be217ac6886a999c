import random
import struct

from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.conftest import SF_SMALL
from tests.llm import brute
from trapline.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int"


def documents():
    r = random.Random(8)
    vocab = ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 6))) for _ in range(300)]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    rows = [(i, " ".join(prose(r.randint(60, 150))) + "\n") for i in range(150)]
    near = prose(120)
    rows += [(200 + i, " ".join(near[:50 + i] + ["other"] + near[51 + i:])) for i in range(8)]
    shared = prose(70)
    rows += [(300 + i, " ".join(prose(60) + shared + prose(60))) for i in range(10)]
    rows += [(400, "too short"), (401, None), (402, "again and again " * 60), rows[3], (500, rows[4][1])]
    return [(d, t, "en", "s", len(t) if t else None, 1) for d, t in rows]


def test_stages(spark):
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    rows = {d: t for d, t, *_ in documents()}
    one = P.quality_rules(spark, docs, SF_SMALL)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert kept == {d for d, t in rows.items() if not brute.base_counts(t)[-1]}
    two = P.near_dedup(spark, one, SF_SMALL).cache()
    got = sorted(r.doc_id for r in two.collect())
    assert two.columns == docs.columns and len(got) == len(set(got))
    assert got == sorted((kept - {500} - set(range(200, 208))) | {200})
    three = P.substring_dedup(spark, two, SF_SMALL)
    assert three.columns == docs.columns
    ids = [r.doc_id for r in two.collect()]
    seqs = [tuple(brute.WORD.findall(rows[d])) for d in ids]
    want = {d: " ".join(w for i, w in enumerate(s) if i not in hit) if hit else rows[d] for d, s, hit in zip(ids, seqs, brute.repeated(seqs, 35))}
    assert {r.doc_id: r.text for r in three.collect()} == want
    assert all(r.n_chars == len(r.text) for r in three.collect())
    assert all(len(want[300 + i].split()) < 125 for i in range(10)) and want[0] == rows[0]
    four = P.mixing(spark, three, SF_SMALL)
    assert four.columns == docs.columns and 0.7 * len(ids) < four.count() <= len(ids)
    tok = Tokenizer.from_file(bpe.vocabulary())
    for r in P.encoding(spark, four, SF_SMALL).collect():
        x = tok.encode(want[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(x)}I", *x) and r.decoded_sha256 == brute.sha(tok.decode(x, skip_special_tokens=False))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.collect() == []
