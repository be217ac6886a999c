import math
import random
from collections import Counter

from tests.conftest import SF_SMALL
from tests.llm import brute
from trapline.llm import fertility as Fe

SCHEMA = "doc_id long, text string, lang string, kept string, row int"
COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts_and_measures(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, r.lang, "x", 1) for r in docs]
    rows += [(-1, None, None, None, None), (-2, "", "en", "x", 1), (-3, "a\n\na\r\n a\na\n", "en", "x", 1), (-4, "\n", "", "x", 1),
             (-5, "a b c " * 40, "en", "x", 1), (-6, "é" * 5000 + " # $", "fr", "x", 1), (-7, "日本 語 " * 3, None, "x", 1)]
    got = {r.doc_id: r for r in Fe.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    enc, sp, fallback, _ = Fe.vocabularies(*Fe.default_vocabularies())
    for d, t, *_ in rows:
        assert tuple(got[d][c] for c in COLS) == brute.base_counts(t), (d, t)
        words = brute.WORD.findall(t or "")
        ids = [i for w in words for i in sp.encode(w)]
        assert got[d].piece_tokens == len(ids) and got[d].byte_tokens == sum(len(enc.encode_ordinary(" " + w)) for w in words)
        if ids:
            c = Counter(ids)
            h = -sum(x / len(ids) * math.log2(x / len(ids)) for x in c.values())
            assert abs(got[d].token_entropy - h / math.log2(max(2, len(ids)))) < 1e-9
            assert abs(got[d].fallback_share - sum(map(int, fallback[ids])) / len(ids)) < 1e-9
    assert got[-7].script == "east asian" and got[-2].script == "other" and got[-6].script == "latin"


def test_bands_reject_strange_text_and_keep_prose(spark):
    r = random.Random(2)
    prose = lambda: " ".join(r.choice("the of and water house people children little great year".split()) + r.choice(["", "s", "ing"]) for _ in range(120))
    rows = [(i, prose(), "en", "x", 1) for i in range(150)]
    rows += [(900, " ".join("".join(r.choice("xqzjkv0189") for _ in range(9)) for _ in range(90)), "en", "x", 1),
             (901, " ".join("ਕሀ\U0001f9ff" for _ in range(80)) + " " + " ".join(chr(0x1300 + k) for k in range(80)), "en", "x", 1),
             (902, prose(), "rare", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {x.doc_id for x in Fe.accepted(df).collect()}
    assert kept == set(range(150)) | {902}
    assert Fe.accepted(df).columns == df.columns
    assert Fe.judge(df.limit(0)).collect() == []


def test_rare_language_is_not_judged_by_another(spark):
    r = random.Random(4)
    prose = lambda w: " ".join(r.choice(w.split()) + r.choice(["", "s", "ing"]) for _ in range(120))
    rows = [(i, prose("the of and water house people children little great year"), "en", "x", 1) for i in range(150)]
    rows += [(500 + i, prose("không được người những trường nghiệp quyền đường"), "vi", "x", 1) for i in range(5)]
    got = {x.doc_id: x for x in Fe.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[500 + i].script == "latin" and got[500 + i].kept for i in range(5))
