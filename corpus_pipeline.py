"""The training-data pipeline: toxic documents, copies, near copies and benchmark leaks go, the rest is encoded.

Null and empty texts are equal to one another: one row of them stays.  A null id stays with its row and counts as
greater than all others.  Of rows equal in id and text one stays.  Texts of any length are worked on whole; an empty
table gives an empty result; further columns of documents are carried up to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from corpusguard.llm.common import keep_named, store, table
from corpusguard.llm.queries import byte_vocabulary, toxicity_model


def _judged(docs: DataFrame, judge: Callable[[list[Column]], DataFrame], kept: str) -> DataFrame:
    """The rows whose judgement meets a condition, with their own columns, whatever those are called.

    The columns travel under names that no judgement uses, so a column of docs that is named like one comes back
    as it was.
    """
    names = [f"__{k}" for k in range(len(docs.columns))]
    own = [F.col(f"`{c}`").alias(name) for c, name in zip(docs.columns, names)]
    return judge(own).where(kept).select(names).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; those without text or hits stay."""
    model = toxicity_model(spark, docs, sf_dir)
    return _judged(docs, lambda own: toxicity.score_toxicity(docs, model, keep=own), "predicted = 0")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts; all empty texts are one group."""
    return keep_named(docs, exact_dedup.deduplicate(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies; texts without words stay."""
    return keep_named(docs, ngram_join.join_near(docs).where("stays"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; an empty benchmark drops none."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _judged(docs, lambda own: decontaminate.find_contamination(docs, benchmark, keep=own), "not contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens and digests of ids and decoded bytes."""
    return bpe.encode_with_digests(docs, byte_vocabulary(), keep=[F.col("doc_id")])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

# No stage but exact deduplication can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
