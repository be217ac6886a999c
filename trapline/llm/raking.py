"""Mixing sources to target weights: iterative proportional fitting.

Documents fall in cells of (source, language, topic); a cell's mass is its
tokens.  Raking multiplies the cells so that the mass of each source, then each
language, then each topic meets its target, ``rounds`` times over; the product
of factors is a cell's weight per token.  One scale then turns weights into
probabilities min(1, scale x weight) whose expected tokens are ``share`` of all
tokens, and a document is sampled if a hash of its id, uniform in [0, 1), lies
below the probability of its cell.

Targets are given as {value: share} for each side; a side without is damped: its
targets are proportional to its own shares to the power ``damping``, so large
sources give way to small ones.  Given targets share what is left by the values
they do not name, each of which keeps its own share as target.  Every value of a
side is raked by itself, however rare.

Texts are counted in one pass, cells are summed with partial sums before the
shuffle, and all rounds run over the written table of cells alone.  A cell's
weight is the product of one factor for each side; a step takes the marginals of
its side by a grouped sum and writes that side's factors, one row a value, which
the next steps join.  The scale is found by Newton steps over sums of the cells.
DataFrame functions only.

Cases: null or empty text has no tokens; null source or language is the value
""; a null id hashes as the empty string; repeated rows share one decision; an
empty table gives an empty result; the documents' own columns stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.session import discard, materialize, scratch_tables

ROUNDS, SHARE, DAMPING, SEED = 8, 0.9, 0.7, "mix"
TOPICS = [("contact", "@|https?://"), ("legal", "(?i)licen[cs]e|copyright"), ("figures", "[0-9]{3}")]
SIDES = ["source", "lang", "topic"]
_WORD = r"[^\x20\x09-\x0D]+"


def topic(text, topics=TOPICS):
    """The first topic whose pattern the text has, else "prose"."""
    text = F.coalesce(text, F.lit(""))
    out = F.lit("prose")
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _sides(docs: DataFrame, source: str, lang: str, text: str, topics) -> list:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [blank(source).alias("source"), blank(lang).alias("lang"), topic(F.col(text), topics).alias("topic")]


def _wanted(cells: DataFrame, side: str, given: dict | None, damping: float, total: int) -> DataFrame:
    """side, want: the target tokens of each value that has tokens; they add up to the total."""
    own = cells.groupBy(side).agg(F.sum("tokens").alias("own")).where(F.col("own") > 0)
    if not given:
        own = own.withColumn("raw", F.pow(F.col("own") / total, F.lit(damping)))
    else:
        aim = F.coalesce(*[F.when(F.col(side) == k, F.lit(float(x))) for k, x in sorted(given.items())])
        named, unnamed = own.select(F.sum(aim), F.sum(F.when(aim.isNull(), F.col("own")))).first()
        rest = 1 - (unnamed or 0) / total
        own = own.withColumn("raw", F.when(aim.isNull(), F.col("own") / total).otherwise(aim * (rest / named if named else 0.0)))
    scale = own.agg(F.sum("raw")).first()[0]
    return materialize(own.select(side, (F.col("raw") * (total / scale if scale else 0.0)).alias("want")), f"want-{side}")


def _scale(cells: DataFrame, share: float, total: int) -> float | None:
    """The scale at which min(1, scale x weight) takes ``share`` of the tokens; None: all.
    From below, each step solves for the cells that are not yet taken whole."""
    scale = None
    while True:
        over = F.lit(False) if scale is None else F.col("weight") * scale > 1
        whole, raked, n = cells.select(F.sum(F.when(over, F.col("tokens")).otherwise(0)),
                                       F.sum(F.when(over, 0.0).otherwise(F.col("tokens") * F.col("weight"))), F.sum(over.cast("long"))).first()
        if not raked or raked <= 0:
            return None
        if scale is not None and n == before:
            return scale
        scale, before = (share * total - whole) / raked, n


def probabilities(cells: DataFrame, targets: dict | None = None, share: float = SHARE, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens, docs) with weight and probability; ``cells``
    is read once a step and should be a written table."""
    targets = targets or {}
    spark, before = cells.sparkSession, set(scratch_tables())
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.select(*SIDES, "tokens", "docs", F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
    want = {side: _wanted(cells, side, targets.get(side), damping, total) for side in SIDES}
    factors: dict[str, DataFrame] = {}

    def weighted(sides) -> DataFrame:
        out, weight = cells.where(F.col("tokens") > 0), F.lit(1.0)
        for side in sides:
            out, weight = out.join(factors[side].withColumnRenamed("factor", f"by_{side}"), side), weight * F.col(f"by_{side}")
        return out.select(*SIDES, "tokens", "docs", weight.alias("weight"))
    for _ in range(rounds):
        for side in SIDES:
            now = weighted([s for s in SIDES if s != side and s in factors]).groupBy(side).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"))
            old = factors.get(side)
            factors[side] = materialize(want[side].join(now, side).select(
                side, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(0.0).alias("factor")), f"factor-{side}")
            if old is not None:
                discard(spark, [x for x in scratch_tables() if any(f"/{x.rsplit('/', 1)[-1]}/" in f for f in old.inputFiles())])
    raked = materialize(weighted(factors).withColumn("weight", F.round("weight", 9)), "weights")
    discard(spark, [x for x in scratch_tables() if x not in before], raked)
    scale = _scale(raked, share, total)
    p = F.lit(1.0) if scale is None else F.least(F.lit(1.0), F.col("weight") * scale)
    none = cells.where(F.col("tokens") == 0).select(*SIDES, "tokens", "docs", F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
    return raked.select("*", F.round(p, 9).alias("probability")).union(none)


def mixed(docs: DataFrame, targets: dict | None = None, share: float = SHARE, damping: float = DAMPING, rounds: int = ROUNDS,
          topics=TOPICS, seed: str = SEED, text: str = "text", source: str = "source",
          lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Every document: row (its columns), doc_id, source, lang, topic, n_tokens,
    weight, probability, selected."""
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD)).cast("long")
    raw = materialize(docs.select(*_sides(docs, source, lang, text, topics), n.alias("n"))
                      .groupBy(*SIDES).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")), "cells")
    cells = materialize(probabilities(raw, targets, share, damping, rounds), "raked")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    uniform = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = docs.select(row.alias("row"), F.col(doc_id).cast("long").alias("doc_id"), *_sides(docs, source, lang, text, topics), n.alias("n_tokens"))
    return (out.join(cells.select(*SIDES, "weight", "probability"), SIDES)
            .select("row", "doc_id", *SIDES, "n_tokens", "weight", "probability", (uniform < F.col("probability")).alias("selected")))


def op5(spark, sf_dir: str) -> DataFrame:
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *SIDES, "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected")


def oracle(rounds: int = ROUNDS, share: float = SHARE, damping: float = DAMPING, seed: str = SEED, topics=TOPICS) -> str:
    """The same in DuckDB SQL."""
    case = " ".join(f"when regexp_matches(coalesce(text, ''), '{p}') then '{n}'" for n, p in topics)
    steps = [f"""d as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, case {case} else 'prose' end as topic,
  len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'))::bigint as n_tokens from documents)"""]
    steps.append("c as (select source, lang, topic, sum(n_tokens)::double as tokens from d group by all)")
    for s in SIDES:
        steps.append(f"""w_{s} as (select {s}, pow(t / (select sum(tokens) from c), {damping}) / sum(pow(t / (select sum(tokens) from c), {damping})) over () as want
  from (select {s}, sum(tokens) as t from c group by {s}) where t > 0)""")
    last = "c0"
    steps.append("c0 as (select *, tokens as mass, sum(tokens) over () as total from c)")
    for k in range(rounds):
        for s in SIDES:
            name = f"r{k}_{s}"
            steps.append(f"{name} as materialized (select a.* replace (coalesce(a.mass * want * total / nullif(sum(a.mass) over (partition by a.{s}), 0), 0) as mass) from {last} a left join w_{s} using ({s}))")
            last = name
    steps.append(f"""f as (select *, case when tokens > 0 then round(mass / tokens, 9) else 0 end as weight from {last})""")
    steps.append(f"""g as (select *, ({share} * total - coalesce(sum(tokens) over b, 0)) /
  nullif(sum(tokens * weight) over () - coalesce(sum(tokens * weight) over b, 0), 0) as scale from f
  window b as (order by weight desc, source, lang, topic rows between unbounded preceding and 1 preceding))""")
    steps.append("h as (select *, max(case when scale * weight <= 1 then scale end) over () as s from g)")
    steps.append("q as (select source, lang, topic, weight, case when tokens = 0 or s is null then 1.0 else round(least(1.0, s * weight), 9) end as probability from h)")
    return ("with " + ",\n".join(steps) + f"""
select doc_id, source, lang, topic, n_tokens, round(weight, 6) as weight, round(probability, 6) as probability,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '{seed}'), 1, 8))::bigint / 4294967296.0 < probability as selected
from d join q using (source, lang, topic)""")
