"""File sources and sinks.

Readers take explicit schemas where the shape is known (no inference pass over the data); nested
JSON keeps its structure as structs, arrays and maps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Trial result line (one JSON object per line).
RESULT_SCHEMA = (
    "task_id string, dataset string, covers array<string>, profile string, model string, trial int, "
    "verdict struct<correct:boolean, single_query:boolean, correct_reasons:array<string>, "
    "single_query_reasons:array<string>, correct_columns:map<string,string>, single_query_columns:map<string,string>, "
    "flags:struct<used_python:boolean, raw_sql:boolean, edited_models:boolean, query_errors:boolean, several_queries:boolean>>, "
    "end_reason string, usage struct<input_tokens:bigint, output_tokens:bigint, cache_read_tokens:bigint, "
    "cache_write_tokens:bigint, partial:boolean>, cost_usd double, duration_s double, xfail string"
)

# One trace document per file; tool arguments stay JSON text (their shape varies by tool).
TRACE_SCHEMA = (
    "profile string, calls array<struct<tool:string, args:string, result_text:string, is_error:boolean, "
    "parsed:struct<columns:array<string>, rows:array<array<string>>, warnings:array<struct<kind:string, message:string>>>>>, "
    "usage struct<input_tokens:bigint, output_tokens:bigint, cache_read_tokens:bigint, cache_write_tokens:bigint, partial:boolean>, "
    "cost_usd double, duration_s double, turns int, end_reason string, error string"
)

STEM_SEP = "__"  # file stem = task__profile__model__trial (fixed format)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A1: CSV with a header; types from ``schema`` when given, else inferred (one extra pass)."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A2: a Parquet table; selecting columns here prunes the scan (ReadSchema)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A4: JSON-lines trial results, also those without a task id; blank lines are skipped, a malformed line raises."""
    return spark.read.schema(RESULT_SCHEMA).option("mode", "FAILFAST").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """A5: one JSON trace per file; the key (task, profile, model, trial) comes from the file name."""
    df = spark.read.schema(TRACE_SCHEMA).option("multiLine", True).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    parts = F.split(stem, STEM_SEP)
    return df.select(
        parts[0].alias("task_id"),
        parts[1].alias("trace_profile"),
        parts[2].alias("model"),
        parts[3].cast("int").alias("trial"),
        "*",
    )


def write_snapshots(df: DataFrame, path: str, key: str = "task_id") -> None:
    """One snapshot folder per key; a rewrite replaces the whole set, so stale snapshots disappear."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def append_results(df: DataFrame, path: str) -> None:
    """Append-only results sink (new files; existing lines are never rewritten)."""
    df.write.mode("append").json(path)
