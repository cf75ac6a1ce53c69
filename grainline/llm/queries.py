"""The registered queries of this package: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bm25, decontam, langid, line_dedup, lm, mixing, periodic, secrets, simhash, tokens, toxicity, wrappers
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated line runs."""
    return line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100."""
    return bm25.search_by_documents(spark, table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents' sources."""
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrappers.extract_pages(spark, table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in every document."""
    return secrets.find_secrets(spark, table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and PPM log probability of every document."""
    return lm.score_documents(spark, table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written to ORC and read back."""
    return tokens.token_output(spark, table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside a benchmark window."""
    return decontam.decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' ids cover every document, with corpus-wide counts of their linked pairs."""
    return align.align(spark, table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words in every document, with planted periods."""
    return periodic.run_report(spark, table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    documents = table(spark, sf_dir, "documents")
    return langid.identify(spark, documents, langid.train(spark, documents))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_topk_search, op3_source_mix, op4_simhash, op5_html_text, op6_secret_scan, op7_lm_score, op8_token_ids, op9_decontamination, op10_toxicity, op11_token_alignment, op12_periodic_runs, op13_language_id, pipeline)
}
ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op3_source_mix": mixing.ORACLE, "op9_decontamination": decontam.ORACLE}
