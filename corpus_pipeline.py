"""From raw documents to token ids: quality rules, near-duplicate removal,
substring dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all the documents that the
stage before has kept; all but the last return the columns of ``documents``.
A stage is written as Parquet and read again before the next, so a lost executor
costs the stage at most.

Cases: those of the operators; an empty table passes through all stages; extra
columns go along to the last stage."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import automaton_dedup, bpe, dart_minhash, fertility, raking
from trapline.session import discard, materialize, scratch_tables

_used: list[str] = []


def stage(fn):
    """A stage first deletes the tables that earlier stages wrote for themselves,
    but for those that its documents are read from."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _used, docs)
        before = set(scratch_tables())
        out = fn(spark, docs, sf_dir)
        _used[:] = [t for t in scratch_tables() if t in _used or t not in before]
        return out
    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their language."""
    return fertility.accepted(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return dart_minhash.representatives(docs)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start at more than one place."""
    return automaton_dedup.cleaned(docs)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities raked to source, language and topic shares."""
    return raking.mixed(docs).where("selected").select("row.*")


@stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the decoded text."""
    out = bpe.encode_documents(docs, bpe.vocabulary())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("mixing", mixing), ("encoding", encoding)]

ORACLE_SQL = None  # the first stage asks tokenisers


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = materialize(step(spark, docs, sf_dir), name)
    return docs
