import hashlib
import random
import struct

from tokenizers import Tokenizer

from tests.conftest import SF_SMALL
from trapline.llm import bpe

ODD = ["", " ", "Don't  we'll it's", "naïve é É ΑΣ ΟΔΟΣ İx ǅ", "a<|endoftext|>b <|startoftext|><|END|>", "12345 ½ ²³ ١٢",
       "\x00\x1c\x1d\x85  　z", "日本語テキスト 한국어", "👩‍👩‍👧 !!! ???...", "x" * 3000, "ab" * 2500 + "é" * 999, "İİ ſ ﬁ ẞ", "​﻿᠎"]


def want(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def test_matches_the_library_on_odd_texts():
    tok, own = Tokenizer.from_file(bpe.vocabulary()), bpe.load(bpe.vocabulary())
    r = random.Random(1)
    odd = ODD + ["".join(r.choice("abcABC '.,!1é漢́\n\tΣ<|>") for _ in range(r.randint(1, 80))) for _ in range(400)]
    for text in odd:
        ids, decoded = want(tok, text)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == decoded, text


def test_query_matches_the_library(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "tie"), (None, "tie")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra)
    tok = Tokenizer.from_file(bpe.vocabulary())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    exp = []
    for r in docs.collect():
        ids, decoded = want(tok, r.text)
        exp.append((r.doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(decoded.encode())))
    got = [tuple(r) for r in bpe.digest_documents(docs, bpe.vocabulary()).collect()]
    assert sorted(got, key=str) == sorted(exp, key=str)
    whole = {r.doc_id: bytes(r.decoded) for r in bpe.encode_documents(docs, bpe.vocabulary()).collect()}
    assert whole[-1] == b"" and len(whole) == docs.distinct().count() - 0
    assert bpe.digest_documents(docs.limit(0), bpe.vocabulary()).collect() == []
