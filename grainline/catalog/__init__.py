"""Registered questions: every reference question rebound to the driver's tables, plus operator checks."""

from __future__ import annotations

from grainline.catalog.registry import QUESTIONS, Question


def all_questions() -> dict[str, Question]:
    # importing the modules registers their questions
    from grainline.catalog import answers, bench, checks, corpus, extras, shop, trial_log  # noqa: F401

    return QUESTIONS
