"""Tool calls with nested arguments: flags, what a call asked and what came back (L6, L8, J).

Arguments are VARIANTs of any shape; an agent may pass JSON text where an object is meant, at any level. SQL is looked for
wherever the tools take it: in a model's own fields, its columns, aggregations and filters, and in the models that the
stages of a query define inline. All of it is Column expressions; a trace is one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.operators.logs import clip, error_kind
from grainline.operators.result_text import kind_of, strip

# The tools of the trace format.
PYTHON_TOOL, SQL_TOOL = "python", "sql"
NO_DATA_TOOLS = ("python", "submit_answer")
QUERY_TOOLS = ("query", "sql")
MODEL_TOOLS = ("create_model", "edit_model")
#: Tools whose errors count as query errors, by kind of surface; elsewhere all data tools do.
SURFACE_TOOLS = {"motley": ("query", "inspect", "search", "create_model", "edit_model", "delete", "save_memory", "switch_branch"), "sql": ("sql",)}
QUERY_FIELDS = ("dimensions", "time_dimensions", "measures", "filters", "order")

_NONE = "array<variant>"


def decoded(v: Column) -> Column:
    """JSON text that stands for an object or a list, as that; anything else as it is."""
    text = F.try_variant_get(v, "$", "string")
    return F.when((kind_of(v) == "STRING") & strip(text).rlike(r"^[\[{]"), F.coalesce(F.try_parse_json(text), v)).otherwise(v)


def items(v: Column) -> Column:
    """The elements of a list, a single value as a list of one, nothing as an empty list."""
    d = decoded(v)
    return F.when(d.isNull() | F.is_variant_null(d), F.array().cast(_NONE)).when(kind_of(d) == "ARRAY", F.try_variant_get(d, "$", _NONE)).otherwise(F.array(d))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def has_text(v: Column) -> Column:
    """Whether a value is text that is not blank."""
    return F.coalesce((kind_of(v) == "STRING") & (strip(F.try_variant_get(v, "$", "string")) != ""), F.lit(False))


def model_has_sql(model: Column) -> Column:
    """Whether a model definition holds SQL: its own, a column's, an aggregation's formula or a filter."""
    return (
        has_text(field(model, "sql"))
        | F.exists(items(field(model, "columns")), lambda c: has_text(field(c, "sql")) | has_text(field(c, "filter")))
        | F.exists(items(field(model, "aggregations")), lambda a: has_text(field(a, "formula")))
        | F.exists(F.concat(items(field(model, "add_filters")), items(field(model, "filters"))), has_text)
    )


def query_has_sql(query: Column) -> Column:
    """Whether a stage of a query defines its source inline with SQL."""

    def stage_has(stage: Column) -> Column:
        source = decoded(field(stage, "source_model"))
        return F.coalesce(kind_of(source) == "OBJECT", F.lit(False)) & model_has_sql(source)

    return F.exists(items(query), stage_has)


def call_has_sql(tool: Column, args: Column) -> Column:
    in_query = query_has_sql(field(args, "query"))
    in_model = model_has_sql(args) | in_query | query_has_sql(field(args, "source_queries"))
    return (tool == SQL_TOOL) | (tool.isin(*MODEL_TOOLS) & in_model) | ((tool == "query") & in_query)


def trace_flags(calls: DataFrame, trace: str, tool: str = "tool", args: str = "args", is_error: str = "is_error", surface: str = "") -> DataFrame:
    """Per trace: calls, used_python, raw_sql, edited_models, query_errors, several_queries.

    ``args`` is a VARIANT (NULL: no arguments). ``surface`` says which tools' errors are query errors.
    """
    t, data = F.col(tool), ~F.col(tool).isin(*NO_DATA_TOOLS)
    erring = t.isin(*SURFACE_TOOLS[surface]) if surface in SURFACE_TOOLS else data
    return calls.groupBy(trace).agg(
        F.count(F.lit(1)).alias("calls"),
        F.bool_or(t == PYTHON_TOOL).alias("used_python"),
        F.bool_or(data & F.coalesce(call_has_sql(t, F.col(args)), F.lit(False))).alias("raw_sql"),
        F.bool_or(t.isin(*MODEL_TOOLS)).alias("edited_models"),
        F.bool_or(F.col(is_error) & erring).alias("query_errors"),
        (F.count(F.when(t.isin(*QUERY_TOOLS), 1)) > 1).alias("several_queries"),
    )


def _compact(v: Column) -> Column:
    return F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _stage_text(stage: Column) -> Column:
    given: Sequence[Column] = [
        F.when(F.size(items(field(stage, f))) > 0, F.concat(F.lit(f"{f}="), F.to_json(field(stage, f)))) for f in QUERY_FIELDS
    ]
    return F.concat_ws(" ", F.coalesce(_compact(field(stage, "source_model")), F.lit("(no source_model)")), *given)


def asked(tool: Column, args: Column) -> Column:
    """What a call asked: the stages of a query, a saved query and its refinement, SQL on one line, else the arguments."""
    query = field(args, "query")
    refine = field(args, "refine")
    saved = F.concat(F.lit("saved query "), F.try_variant_get(query, "$", "string"), F.coalesce(F.concat(F.lit(" refined by "), F.to_json(refine)), F.lit("")))
    stages = F.array_join(F.transform(F.filter(items(query), lambda s: kind_of(s) == "OBJECT"), _stage_text), " ; ")
    in_query = F.when((kind_of(query) == "STRING") & ~strip(F.try_variant_get(query, "$", "string")).rlike(r"^[\[{]"), saved).otherwise(F.when(stages != "", stages).otherwise(F.to_json(args)))
    sql = field(args, "sql")
    one_line = strip(F.regexp_replace(F.try_variant_get(sql, "$", "string"), r"[\s\x0B]+", " "))
    return F.when(tool == "query", in_query).when((tool == SQL_TOOL) & (kind_of(sql) == "STRING"), one_line).otherwise(F.to_json(args))


def outcome(is_error: Column, text: Column, parsed: Column) -> Column:
    """What came back: an error and its class, the number of rows and the kinds of the warnings, or ok."""
    kinds = F.array_join(F.transform(parsed["warnings"], lambda w: F.concat(F.lit(", "), w["kind"], F.lit(" warning"))), "")
    return (
        F.when(is_error, F.concat(F.lit("error"), F.coalesce(F.concat(F.lit(" "), error_kind(text)), F.lit(""))))
        .when(parsed.isNotNull(), F.concat(F.size(parsed["rows"]).cast("string"), F.lit(" rows"), kinds))
        .otherwise(F.lit("ok"))
    )


def call_digest(calls: DataFrame, trace: str, call: str, tool: str = "tool", args: str = "args", is_error: str = "is_error", text: str = "result_text", parsed: str = "parsed") -> DataFrame:
    """Per data call ``#n `tool` what was asked -> what came back``; calls count from 1 and keep their number.

    What was asked is clipped for display, after the whole of it was built; keys of printed objects are in order.
    """
    kept = calls.where(~F.col(tool).isin(*NO_DATA_TOOLS))
    line = F.concat(F.lit("#"), F.col(call).cast("string"), F.lit(" `"), F.col(tool), F.lit("` "), clip(asked(F.col(tool), F.col(args))), F.lit(" → "), outcome(F.col(is_error), F.col(text), F.col(parsed)))
    return kept.select(trace, call, line.alias("line"))
