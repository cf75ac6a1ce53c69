"""The corpus pipeline: documents -> toxicity -> near-dedup -> decontamination -> source mix -> token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the rows it keeps with the
columns of ``documents``; the last one writes token files and returns what they hold. ``run`` writes every stage's rows
as Parquet to the shared folder and rereads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainline.llm import decontam, mixing, simhash, tokens, toxicity
from grainline.llm.common import Scratch, opened, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go. It is fitted on the labelled rows of the given documents."""
    return toxicity.drop_toxic(spark, docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id, or without any id if none has one."""
    return simhash.keep_one(spark, docs, repeats=False)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.apply_mix(spark, docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; returns their digest per document copy."""
    return tokens.token_output(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("token_ids", write_token_ids),
]

#: Fingerprints and token ids are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote for itself goes once its rows are written, and its input too."""
    scratch = Scratch(spark, "pipeline")
    mark = opened()
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        release(mark)
        scratch.drop(before)
    return docs
