import numpy as np

from scripts.compare import duck, rows_of
from tests.conftest import SF_SMALL
from trapline.llm import raking as R

SCHEMA = "doc_id long, text string, lang string, source string, topic string, weight int"


def test_matches_sql(spark):
    sc, sr = rows_of(R.op5(spark, SF_SMALL).toPandas())
    dc, dr = rows_of(duck(SF_SMALL).execute(R.oracle()).fetchdf())
    assert sc == dc and sorted(sr, key=str) == sorted(dr, key=str)


def test_marginals_and_budget(spark):
    r = np.random.default_rng(3)
    rows = [(i, "w " * int(r.integers(20, 200)) + r.choice(["", "a@b", "license", "123"]), r.choice(["en", "fr"], p=[.8, .2]),
             r.choice(["a", "b", "c"], p=[.7, .2, .1]), "x", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.7, "fr": 0.3}}
    out = R.mixed(df, targets, share=0.2, rounds=20).toPandas()
    mass = out.n_tokens * out.probability
    assert abs(mass.sum() / out.n_tokens.sum() - 0.2) < 1e-3
    for side in targets:
        got = mass.groupby(out[side]).sum() / mass.sum()
        assert all(abs(got[k] - x) < 1e-3 for k, x in targets[side].items()), got
    assert abs(out.n_tokens[out.selected].sum() / out.n_tokens.sum() - 0.2) < 0.02


def test_cases(spark):
    rows = [(None, None, None, None, None, None), (1, "", "en", "s", "t", 1), (2, "a b", "en", "s", "t", 1), (2, "a b", "en", "s", "t", 1), (3, "x " * 5000, "fr", "z", "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = R.mixed(df).select("row.*", "selected", "probability").collect()
    assert len(out) == 5 and len({r.selected for r in out if r.doc_id == 2}) == 1 and all(0 <= r.probability <= 1 for r in out)
    assert R.mixed(df.limit(0)).collect() == []


def test_rare_values_have_marginals_of_their_own(spark):
    """A source of a third gives way to 400 small ones; two rare languages are raked apart."""
    rows = [(i, "w " * 100, "en" if i % 400 else "la", "hot" if i < 2000 else f"s{i % 400}", "x", 1) for i in range(6000)]
    rows += [(9000 + i, "w " * 100, "eo", "hot", "x", 1) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = R.mixed(df, share=0.2, rounds=20).toPandas()
    mass = out.n_tokens * out.probability
    own = out.n_tokens.groupby(out.source).sum() / out.n_tokens.sum()
    want = (own ** R.DAMPING / (own ** R.DAMPING).sum())["hot"]
    got = (mass.groupby(out.source).sum() / mass.sum())["hot"]
    assert want < 0.1 and abs(got - want) < 0.02, (got, want)
    assert out.weight[out.lang == "eo"].max() != out.weight[(out.lang == "la") & (out.source == "hot")].max()


def test_values_not_named_keep_their_share(spark):
    rows = [(i, "w " * 100, "en", "abcd"[i % 4], "x", 1) for i in range(2000)]
    out = R.mixed(spark.createDataFrame(rows, SCHEMA), {"source": {"a": 0.4, "b": 0.1}}, share=0.2).toPandas()
    mass = (out.n_tokens * out.probability).groupby(out.source).sum()
    mass /= mass.sum()
    assert all(abs(mass[k] - x) < 1e-3 for k, x in {"a": 0.4, "b": 0.1, "c": 0.25, "d": 0.25}.items()), mass


def test_rare_sources_match_sql(spark):
    """A source of a third of the rows and 1,000 small ones: no value is pooled on either side."""
    import duckdb
    r = np.random.default_rng(6)
    rows = [(i, "w " * int(r.integers(1, 60)) + str(r.choice(["", "a@b.cc", "12 34"])), str(r.choice(["en", "fr", "xx"], p=[.7, .29, .01])),
             "hot" if i % 3 == 0 else f"s{i % 1000}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.register("given", df.toPandas())
    con.sql("create table documents as select * from given")
    want = con.sql(R.oracle()).df().set_index("doc_id")
    got = R.mixed(df).select("row.doc_id", "probability", "weight").toPandas().set_index("doc_id")
    assert len(got) == len(want) == 6000
    gap = (got.probability - want.probability.reindex(got.index)).abs()
    assert gap.max() < 2e-6, gap.max()
    assert want.weight.nunique() > 100
