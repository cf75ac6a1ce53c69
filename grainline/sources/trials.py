"""A trial log bound to the driver's ``labels`` and ``documents``: each label is the trial of a task (its document).

The profile is the document's source, the model its language, correctness its quality label, the single query its other
label; what a trial covers comes from the document's length. Every label with a document is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.operators.logs import ALL_ROWS, FLAGS, PITFALLS
from grainline.sources.bindings import Tables


#: A trial has a flag when its document's length is divisible by this.
FLAG_STEPS = {"used_python": 7, "raw_sql": 9, "edited_models": 8, "query_errors": 6, "several_queries": 10}


def _array(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial results with the nested columns of ``files.RESULT_SCHEMA`` that the scoreboards read."""
    t = Tables(spark, sf_dir)
    d = t("labels").join(t("documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    n = F.col("n_chars")
    rows, pits = _array(ALL_ROWS), _array(PITFALLS)
    covers = F.filter(
        F.array(
            F.get(rows, (n % len(ALL_ROWS)).cast("int")),
            F.when(n % 3 == 0, F.get(rows, (n % 7).cast("int"))),
            F.when(n % 5 == 0, F.get(pits, (n % len(PITFALLS)).cast("int"))),
        ),
        lambda c: c.isNotNull(),
    )
    flags = F.struct(*[(n % FLAG_STEPS[f] == 0).alias(f) for f in FLAGS]).alias("flags")
    verdict = F.when(n % 11 != 0, F.struct((F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("single_query"), flags))
    usage = F.struct(
        n.alias("input_tokens"), (n % 97).alias("output_tokens"), (n * 2).alias("cache_read_tokens"), (n % 5).alias("cache_write_tokens"), (n % 13 == 0).alias("partial")
    )
    return d.select(
        F.concat(F.lit("d"), (F.col("doc_id") % 1000).cast("string")).alias("task_id"),
        F.when(n % 4 == 0, "jaffle").otherwise("bench").alias("dataset"),
        covers.alias("covers"),
        F.when(n % 12 == 0, "refusal").when(n % 18 == 0, "warning").otherwise("match").alias("expect"),
        F.col("source").alias("profile"),
        F.col("lang").alias("model"),
        F.col("doc_id").alias("trial"),
        verdict.alias("verdict"),
        usage.alias("usage"),
        F.when(n % 6 != 0, (n % 100).cast("double") / 4).alias("cost_usd"),
        (n.cast("double") / 8).alias("duration_s"),
        F.when(n % 17 == 0, "DEV-1").alias("xfail"),
    )
