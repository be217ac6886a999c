import bisect
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF_SMALL
from tests.llm.test_bpe import ODD
from trapline.llm import exact_packing as X

PATH = public_tokenizers.path("word_bpe_49k.json")


def want_pieces(rows, capacity):
    tok, out = Tokenizer.from_file(PATH), []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            out.append((d, k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out, key=str)


def best_fit_decreasing(lengths, capacity):
    room, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(room, x)
        if k == len(room):
            n += 1
            bisect.insort(room, capacity - x)
        else:
            bisect.insort(room, room.pop(k) - x)
    return n


def check(rows, got, capacity):
    """Pieces as they should be, each sequence gapless from 0; how many sequences."""
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want_pieces(rows, capacity)
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_words_together_are_texts_whole(spark):
    r = random.Random(1)
    rows = [(i, t) for i, t in enumerate([*ODD, None, "<|endoftext|>", " <|startoftext|>x<|endoftext|> y", "a\x0bb\x0cc\x85d e", "é ́e"])]
    rows += [(100 + i, "".join(r.choice("abcABCstSeH '.,!1éÀ×漢\u0301\u0331\n\t\x0b\r Σ<|>") for _ in range(r.randint(1, 80)))) for i in range(1500)]
    docs = spark.createDataFrame([(d, t, "clash", 9) for d, t in rows], "doc_id long, text string, length string, offset int").repartition(4)
    cut = X.pieces(docs, PATH, capacity=64, with_ids=True)
    got = X.packed(cut, 64).collect()
    lengths = [r.length for r in got]
    assert check(rows, got, 64) <= best_fit_decreasing(lengths, 64)
    for g in got:
        assert zlib.crc32(g.ids) == g.ids_crc32 and len(g.ids) == 4 * g.length


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = X.op13(spark, SF_SMALL).collect()
    n = check(rows, got, 4096)
    assert n == -(-sum(r.length for r in got) // 4096)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_no_worse_than_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = [50, 64, 512, 4096, 4096, 300][seed]
    lengths = np.minimum(capacity, 1 + rng.lognormal(np.log(capacity / [3, 10, 2, 5, 2, 1.5][seed]), 1, 5000).astype(int))
    if seed == 5:
        lengths = rng.integers(110, 180, 5000)  # nothing fills a gap exactly for long
    plan = X.best_plan(np.bincount(lengths, minlength=capacity + 1), capacity)
    assert plan.used.tolist() == np.bincount(lengths, minlength=capacity + 1).tolist() and plan.sequences <= best_fit_decreasing(lengths.tolist(), capacity)


def test_hot_length_ties_long_texts_and_empty_tables(spark):
    rows = [(i, "the") for i in range(3000)] + [(5, "the"), (None, None), (None, None), (-1, ""), (-2, "a " * 4095), (-3, "a " * 4096), (-4, "b c " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = X.packed(X.pieces(docs, PATH)).collect()
    assert check(rows, got, 4096) == -(-sum(r.length for r in got) // 4096)
    assert X.packed(X.pieces(docs.limit(0), PATH)).collect() == []
