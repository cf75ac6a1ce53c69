"""Registry of questions: name -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from grainline.catalog.views import with_views


@dataclass(frozen=True)
class Question:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    covers: tuple[str, ...] = ()


QUESTIONS: dict[str, Question] = {}


def question(name: str, sql: str | None = None, covers: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL (binding views inlined)."""

    def deco(fn):
        if name in QUESTIONS:
            raise ValueError(f"duplicate question {name}")
        QUESTIONS[name] = Question(name, fn, with_views(sql) if sql else None, covers)
        return fn

    return deco
