"""Result texts to typed rows (A8), with VARIANT cells.

A text is a markdown table, a JSON array of records, ``{"data": [..], "warnings": [..]}`` or ``{"columns": [..], "rows": [..]}``
- with column names and list rows, or column objects and records. A leading block that starts with ``SQL:`` is skipped up
to the first blank line that a result follows. Shapes are told apart by the schema of the parsed VARIANT; everything is a
Column expression over one row, so a text meets no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainline.operators.logs import warning_kind

PARSED = "struct<columns:array<string>,rows:array<array<variant>>,warnings:array<struct<kind:string,message:string>>>"

# What the given results look like.
_SEPARATOR = r"^\|(:?-+:?\|)+$"
_INTEGER, _NUMBER = r"^-?\d+$", r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"
_TRUNCATED = r"^_\(truncated to \d+ rows"
_BLANK = r"[ \t\n\r\f\x0B]+"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{_BLANK}|{_BLANK}$", "")


def kind_of(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, VOID (a JSON null), BIGINT, .. of a VARIANT."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _warnings(kinds: Column | None = None) -> Column:
    return F.array().cast("array<struct<kind:string,message:string>>") if kinds is None else kinds


def _table(columns: Column, rows: Column, warnings: Column) -> Column:
    return F.struct(columns.alias("columns"), rows.alias("rows"), warnings.alias("warnings")).cast(PARSED)


def _cell(text: Column) -> Column:
    """A markdown cell: empty is NULL, a number a number, else text."""
    whole = F.coalesce(text.try_cast("bigint").cast("variant"), text.try_cast("decimal(38,0)").cast("variant"), text.try_cast("double").cast("variant"))
    return F.when(text == "", F.lit(None).cast("variant")).when(text.rlike(_INTEGER), whole).when(text.rlike(_NUMBER), text.cast("double").cast("variant")).otherwise(text.cast("variant"))


def _split_cells(line: Column) -> Column:
    inside = F.regexp_replace(strip(line), r"(?s)^.(.*).$", "$1")
    return F.transform(F.split(inside, r"\|", -1), strip)


def _markdown(text: Column) -> Column:
    lines = F.split(text, r"\r\n|\n|\r", -1)
    below = F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))
    end = F.array_position(F.transform(below, lambda x: strip(x).startswith("|")), F.lit(False)).cast("int")  # the first line that is no row
    body = F.when(end > 0, F.slice(below, F.lit(1), end - 1)).otherwise(below)
    rest = F.transform(F.when(end > 0, F.slice(below, end, F.size(below) - end + 1)).otherwise(F.array().cast("array<string>")), strip)
    cut = F.when(F.exists(rest, lambda x: x.rlike(_TRUNCATED)), F.array(F.struct(F.lit("truncated").alias("kind"), F.lit("").alias("message")))).otherwise(_warnings())
    after = F.array_position(rest, F.lit("Warnings:")).cast("int")
    listed = F.when(after > 0, F.slice(rest, after + 1, F.greatest(F.size(rest) - after, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(listed, lambda x: x.startswith("- ")), F.lit(False)).cast("int")
    items = F.transform(F.when(stop > 0, F.slice(listed, F.lit(1), stop - 1)).otherwise(listed), lambda x: F.substring(x, 3, 1 << 30))
    told = F.transform(items, lambda m: F.struct(warning_kind(m).alias("kind"), m.alias("message")))
    is_table = (F.size(lines) >= 2) & F.regexp_replace(F.get(lines, F.lit(1)), " ", "").rlike(_SEPARATOR)
    rows = F.transform(body, lambda x: F.transform(_split_cells(x), _cell))
    return F.when(is_table, _table(_split_cells(F.get(lines, F.lit(0))), rows, F.concat(cut, told)))


def _records(items: Column, maps: Column, warnings: Column) -> Column:
    """Records as a table: the keys of all of them in order of appearance; ``items`` are the same records as VARIANTs."""
    keys = F.array_distinct(F.flatten(F.transform(maps, F.map_keys)))
    rows = F.transform(maps, lambda r: F.transform(keys, lambda k: _no_null(F.try_element_at(r, k))))
    objects = F.forall(items, lambda x: kind_of(x) == "OBJECT")
    return F.when(objects & maps.isNotNull(), _table(keys, rows, warnings))


def _no_null(v: Column) -> Column:
    """A JSON null as NULL."""
    return F.when(~F.is_variant_null(v), v)


def _json(text: Column) -> Column:
    v = F.try_parse_json(text)
    as_list = "array<variant>"
    cols, rows = (F.try_variant_get(v, f"$.{k}", as_list) for k in ("columns", "rows"))
    cut = F.coalesce(F.try_variant_get(v, "$.truncated", "boolean") & (kind_of(F.try_variant_get(v, "$.truncated", "variant")) == "BOOLEAN"), F.lit(False))
    warned = F.when(cut, F.array(F.struct(F.lit("truncated").alias("kind"), F.lit("").alias("message")))).otherwise(_warnings())
    lists = F.forall(cols, lambda c: kind_of(c) == "STRING") & F.forall(rows, lambda r: kind_of(r) == "ARRAY")
    listed = _table(
        F.transform(cols, lambda c: F.try_variant_get(c, "$", "string")), F.transform(rows, lambda r: F.transform(F.try_variant_get(r, "$", as_list), _no_null)), warned
    )
    named = F.transform(cols, lambda c: F.try_variant_get(c, "$.name", "variant"))
    names = F.transform(named, lambda n: F.try_variant_get(n, "$", "string"))
    as_map = "map<string,variant>"
    objects = (
        F.forall(cols, lambda c: kind_of(c) == "OBJECT")
        & F.forall(named, lambda n: F.coalesce(kind_of(n) == "STRING", F.lit(False)))
        & (F.size(F.array_distinct(names)) == F.size(names))
        & F.forall(rows, lambda r: (kind_of(r) == "OBJECT") & (F.array_sort(F.map_keys(F.try_variant_get(r, "$", as_map))) == F.array_sort(names)))
    )
    keyed = _table(names, F.transform(rows, lambda r: F.transform(names, lambda n: _no_null(F.try_element_at(F.try_variant_get(r, "$", as_map), n)))), warned)
    in_data = F.from_json(text, "struct<data:array<map<string,variant>>>")["data"]
    told = F.transform(
        F.filter(F.coalesce(F.try_variant_get(v, "$.warnings", as_list), F.array().cast(as_list)), lambda w: F.try_variant_get(w, "$.kind", "variant").isNotNull()),
        lambda w: F.struct(F.try_variant_get(w, "$.kind", "string").alias("kind"), F.coalesce(F.try_variant_get(w, "$.hint", "string"), F.lit("")).alias("message")),
    )
    has_columns = F.try_variant_get(v, "$.columns", "variant").isNotNull()
    return (
        F.when((kind_of(v) == "OBJECT") & has_columns, F.when(cols.isNotNull() & rows.isNotNull() & lists, listed).when(cols.isNotNull() & rows.isNotNull() & objects, keyed))
        .when(kind_of(v) == "OBJECT", _records(F.try_variant_get(v, "$.data", as_list), in_data, told))
        .when(kind_of(v) == "ARRAY", _records(F.try_variant_get(v, "$", as_list), F.from_json(text, "array<map<string,variant>>"), _warnings()))
    )


def _shape(text: Column) -> Column:
    t = strip(text)
    return F.when(t.startswith("|"), _markdown(t)).when(t.startswith("{") | t.startswith("["), _json(t))


def parse(text: Column) -> Column:
    """The text as ``PARSED``: column names, rows of VARIANT cells (a JSON null is NULL) and warnings; NULL if it is no result.

    A warning of a markdown footer gets its kind from its text; one of a JSON object has ``kind`` and its ``hint``.
    """
    t = strip(text)
    parts = F.split(t, r"\n\n", -1)
    after = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.greatest(F.size(parts) - i + 1, F.lit(0))), "\n\n"))
    found = F.filter(F.transform(after, _shape), lambda p: p.isNotNull())
    return F.when(t.startswith("SQL:"), F.get(found, F.lit(0))).otherwise(_shape(t))


def parse_texts(df: DataFrame, text: str, name: str = "parsed") -> DataFrame:
    """``df`` with the parsed text as ``name``."""
    return df.withColumn(name, parse(F.col(text)))


def result_rows(df: DataFrame, parsed: str, keys: list[str], row: str = "row_no") -> DataFrame:
    """One row per cell of parsed results: ``keys``, ``row`` (from 0), ``column``, ``cell`` (VARIANT) and its kind."""
    rows = df.select(*keys, F.col(f"{parsed}.columns").alias("__c"), F.posexplode(f"{parsed}.rows").alias(row, "__r"))
    cells = rows.select(*keys, row, "__c", F.posexplode("__r").alias("__i", "cell"))
    return cells.select(*keys, F.col(row).cast("long").alias(row), F.get(F.col("__c"), F.col("__i")).alias("column"), "cell", kind_of(F.col("cell")).alias("cell_kind"))
