import random

import numpy as np
import pyarrow as pa

from tests.llm import brute
from trapline.llm import common as C
from trapline.llm import dart_minhash as D


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    out = []
    for g in range(25):
        base = [word() for _ in range(r.randint(5, 200))]
        out.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 6])):
                w[r.randrange(len(w))] = word()
            out.append(r.choice([" ", "\n"]).join(w))
    line = " ".join(word() for _ in range(6)) + "\n"
    return out + [line * 30, line * 29, line * 3, None, "", " ", "one", "one", "two words", "two words"]


def test_signatures_estimate_the_index():
    a, b = "x y z q w e r t " * 3 + "u i o p " * 40, "x y z q w e r t " * 2 + "u i o p " * 33 + "k l m n b"
    data, offs = C.buffers(pa.array([a, b]))
    sig = D.signatures(*D.shingles(data, offs), 2, 4000)
    real = brute.jaccard(brute.shingle_counts(a), brute.shingle_counts(b))
    assert abs((sig[0] == sig[1]).mean() - real) < 0.035
    weight = np.array([0.3, 5.5, 2.0, 0.6, 7.0, 2.0])
    sig = D.signatures(np.array([0, 0, 0, 1, 1, 1]), np.array([7, 8, 9, 7, 8, 9], np.uint64), weight, 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - (0.3 + 5.5 + 2.0) / (0.6 + 7.0 + 2.0)) < 0.035


def test_classes_match_all_pairs(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(rows)], "doc_id long, text string, fp string, label int").repartition(3)
    got = {r.doc_id: (r.class_id, r.class_size) for r in D.classes(df).collect()}
    want = brute.classes(rows)
    least = {c: min(i for i, x in enumerate(want) if x == c) for c in want}
    assert got == {i: (least[c], want.count(c)) for i, c in enumerate(want)}


def test_links_that_no_centre_sees(spark):
    """Many documents share most of a passage, so that they meet in buckets of
    mixed classes; pairs among them are near copies of each other only."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, rows = [word() for _ in range(90)], []
    for _ in range(60):
        w = passage + [word() for _ in range(35)]
        rows.append(" ".join(w))
        if r.random() < 0.6:
            w[r.randrange(95, 125)] = word()
            rows.append(" ".join(w))
    r.shuffle(rows)
    got = {x.doc_id: x.class_id for x in D.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    want = brute.classes(rows)
    least = {c: min(i for i, x in enumerate(want) if x == c) for c in want}
    assert got == {i: least[c] for i, c in enumerate(want)}
    assert len(set(want)) == 60


def test_components_with_a_link_are_joined(spark):
    """Components given by hand in one bucket: whatever their centres say, two of
    them with a link end as one, and others stay apart."""
    from pyspark.sql import functions as F

    from trapline.llm.components import components
    from trapline.session import materialize
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, sets = [word() for _ in range(60)], []
    for _ in range(120):  # one change breaks five shingles of 56: two apart are links, three are not always
        w = list(base) if r.random() < 0.8 else [word() for _ in range(60)]
        for at in r.sample(range(0, 60, 6), r.choice([0, 1, 2, 3])):
            w[at] = word()
        sets.append(" ".join(w))
    label = [r.randrange(25) for _ in sets]
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(sets)], ["fp", "text"])
    body = spark.createDataFrame([(b["fp"], b["body"]) for out in D._lists(5)([batch]) for b in out.to_pylist()], "fp long, body binary")
    contested = spark.createDataFrame([(i, 1000 + c, r.randrange(9), 7) for i, c in enumerate(label)], "fp long, label long, meets long, bucket long")

    def measured(pairs, b):
        full = pairs.join(b.select(F.col("fp").alias("a"), F.col("body").alias("body_a")), "a").join(b.select(F.col("fp").alias("b"), F.col("body").alias("body_b")), "b")
        return materialize(full.mapInArrow(D._distances, "a long, b long, far double"), "distances")

    s = [brute.shingle_counts(t) for t in sets]
    own = [(i, label.index(c)) for i, c in enumerate(label)]
    want = brute.merged(120, own + [(i, j) for i in range(120) for j in range(i) if brute.jaccard(s[i], s[j]) >= 0.8])
    found = [(x.a, x.b) for links in D._across(contested, body, 0.8, measured) for x in links.collect()]
    assert all(brute.jaccard(s[a], s[b]) >= 0.8 for a, b in found)
    assert brute.merged(120, own + found) == want
    assert 1 < len(set(want)) < 25
    assert components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count() == 3


def test_repeated_null_and_empty(spark):
    schema = "doc_id long, text string"
    got = D.classes(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z")], schema)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == sorted([(1, 1, 3), (1, 1, 3), (None, 1, 3), (None, None, 1)], key=str)
    assert D.classes(spark.createDataFrame([], schema)).collect() == []
