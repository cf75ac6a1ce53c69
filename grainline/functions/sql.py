"""The library's formulas as SQL functions of a session (D16, UDF surface).

``register`` makes temporary functions with SQL bodies, so a SQL text calls them by name and the optimizer inlines them like
any expression: no Python runs. ``register_template`` gives a custom aggregation formula a name; ``register_table`` a
parameterised query, called in FROM.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import SparkSession

#: name -> (parameters, result type, body).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "gl_ratio": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN b <> 0 THEN a / b END"),
    "gl_change_pct": ("now DOUBLE, before DOUBLE", "DOUBLE", "CASE WHEN before <> 0 THEN 100 * (now - before) / before END"),
    "gl_cents": ("amount DECIMAL(18,2)", "BIGINT", "CAST(round(amount * 100) AS BIGINT)"),
    "gl_close": ("a DOUBLE, b DOUBLE, tol DOUBLE", "BOOLEAN", "(a IS NULL AND b IS NULL) OR coalesce(abs(a - b) <= tol * greatest(1D, abs(a), abs(b)), false)"),
    "gl_half_year": ("day DATE", "STRING", "concat(year(day), '-H', CASE WHEN month(day) <= 6 THEN 1 ELSE 2 END)"),
}

_NAME = re.compile(r"^[A-Za-z_]\w*$")


def _checked(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"{name!r} is no function name")
    return name


def register(spark: SparkSession, functions: Mapping[str, tuple[str, str, str]] = FUNCTIONS) -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for name, (parameters, kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_checked(name)}({parameters}) RETURNS {kind} RETURN {body}")
    return list(functions)


def register_template(spark: SparkSession, name: str, body: str, kind: str = "DOUBLE", value: str = "DOUBLE") -> None:
    """An aggregation formula over a group's sum and count, ``v_sum`` and ``v_count``; called as ``name(sum(x), count(x))``."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_checked(name)}(v_sum {value}, v_count BIGINT) RETURNS {kind} RETURN {body}")


def register_table(spark: SparkSession, name: str, parameters: str, columns: str, query: str) -> None:
    """A table function: ``SELECT .. FROM name(arguments)`` runs ``query`` with its parameters bound, as part of the plan."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {_checked(name)}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
