import random

import pytest

from tests.llm import brute
from trapline.llm import automaton_dedup, suffix_dedup, windows


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60), text(120), text(36), "na " * 90]
    rows = [(i, text(r.randint(0, 150))) for i in range(40)]
    rows += [(100 + i, text(r.randint(0, 30)) + " " + r.choice(shared) + "\t" + text(r.randint(0, 30)) + " " + r.choice(shared))
             for i in range(60)]
    rows += [(200 + i, shared[1]) for i in range(4)] + [(300, None), (301, ""), (302, "  \n"), (None, text(80)), (303, "x" * 1500)]
    rows += [(304, "ab" * 700), rows[5], rows[5], (305, shared[2]), (306, " ".join(shared[1].split()[:35]))]
    return rows


SCHEMA = "doc_id long, text string, start int, h string, spans int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", None) for d, t in rows], SCHEMA).repartition(3)


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("length", [400, 50])
def test_bytes(spark, length):
    rows = corpus()
    got = suffix_dedup.remove_repeats(frame(spark, rows), length, gram=16).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in got]
    assert sorted(got, key=key) == sorted(brute.op6(rows, length), key=key)


@pytest.mark.parametrize("large", [2000, 2])
def test_words(spark, large, monkeypatch):
    monkeypatch.setattr(windows.repeated_spans, "__defaults__", (False, large))
    rows = corpus()
    got = [(r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept)) for r in automaton_dedup.remove_spans(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(brute.op8(rows), key=key)


def test_large_groups_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(windows.repeated_spans, "__defaults__", (False, 2))
    rows = corpus()
    got = [(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted([(x[0], x[2]) for x in brute.op6(rows)], key=key)


@pytest.mark.parametrize("large", [2000, 2])
def test_first_copy_stays(spark, large, monkeypatch):
    monkeypatch.setattr(windows.repeated_spans, "__defaults__", (False, large))
    rows = sorted({d: t for d, t in corpus() if d}.items())
    words = [tuple(brute.WORD.findall(t or "")) for _, t in rows]
    want = {d: len(x) for (d, _), x in zip(rows, brute.repeated(words, 35, first=True))}
    assert {r.doc_id: r.n_removed for r in automaton_dedup.remove_spans(frame(spark, rows), keep="first").collect()} == want
    raw = [(t or "").encode() for _, t in rows]
    want = {d: len(x) for (d, _), x in zip(rows, brute.repeated(raw, 400, first=True))}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(frame(spark, rows), keep="first").collect()} == want


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []
    assert automaton_dedup.remove_spans(frame(spark, [])).collect() == []
