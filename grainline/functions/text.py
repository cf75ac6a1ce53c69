"""Text scans (B17, B18): whole-word phrase hits and missing markers, as column expressions.

Both work row by row inside whole-stage code generation (``rlike``/``contains``); the phrase list is a
small fixed argument expanded into one expression per phrase, so no join or cross product with a phrase
table is needed and each text is read once.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and DSL syntax that a task prompt must not contain (whole words, any case) - fixed values.
DENY_PHRASES = (
    "partition_by", "time_shift", "cumsum", "change_pct", "window=", "rank(", "consecutive_periods", "weighted_avg",
    "count_distinct", "date_part", "date_diff", "date_add", "refine", "source_model", "source_queries", "multi-stage",
    "to_many_handling", "time_dimensions", "query-backed", "join", "joins", "joined", "joining", "duplicate",
    "duplicates", "duplicated", "double count", "double-count", "double counting", "double-counting", "fan-out",
    "fan out", "fans out", "chasm", "null", "nulls", "not in", "counted once", "count once", "counts once",
    "counting once", "count each", "counting each",
)

_SPECIAL = set("\\.^$|?*+()[]{}")
# A letter, digit or underscore in any script: the edge of a word.
_WORD = r"\pL\pN_"


def escape(text: str) -> str:
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in text)


def phrase_pattern(phrase: str) -> str:
    """Case-insensitive pattern of ``phrase`` as a whole word; a symbol edge gets no boundary.

    The boundary is written as a consuming group (start/end or a non-word character) instead of ``\\b``
    so Java's and RE2's regex engines agree on Unicode text.
    """
    lead = f"(^|[^{_WORD}])" if phrase[0].isalnum() else ""
    trail = f"([^{_WORD}]|$)" if phrase[-1].isalnum() else ""
    return "(?i)" + lead + escape(phrase) + trail


def _first_word(phrase: str) -> str | None:
    """The leading word of a phrase that starts with a word character (None otherwise)."""
    m = re.match(r"[0-9A-Za-z_]+", phrase.lower())
    return m.group(0) if m else None


def phrase_hits(df: DataFrame, key: str, text: str, phrases: Sequence[str] = DENY_PHRASES, name: str = "phrase") -> DataFrame:
    """One row per (key, phrase) whose text holds the phrase as a whole word, any case.

    One pass per text: the lower-cased text is split once into its distinct word tokens, which are
    intersected (hash-based) with the phrases' first words. A phrase that starts with a word character
    can only match as a whole word if its first word is one of the tokens, so the exact case-insensitive
    regex runs only for those candidates. Both helper columns are separate projections, computed once
    per row (Catalyst does not inline a non-trivial expression that is used many times).
    """
    firsts = sorted({w for p in phrases if (w := _first_word(p))})
    tokens = F.array_distinct(F.split(F.lower(F.col(text)), f"[^{_WORD}]+"))
    base = df.select(F.col(key), F.col(text), F.array_intersect(tokens, F.array(*[F.lit(w) for w in firsts])).alias("__cand"))
    t = F.col(text)

    def test(p: str) -> Column:
        w = _first_word(p)
        exact = t.rlike(phrase_pattern(p))
        return exact if w is None else F.array_contains(F.col("__cand"), w) & exact

    found = F.array(*[F.when(test(p), F.lit(p)) for p in phrases])
    # explode the plain array and drop the NULLs afterwards: no lambda, so the scan stays in generated code
    return base.select(F.col(key), F.explode(found).alias(name)).where(F.col(name).isNotNull())


def compact(text: Column) -> Column:
    """Text with all whitespace removed."""
    return F.regexp_replace(text, r"\s+", "")


def missing_markers(df: DataFrame, key: str, text: str, labels: str, markers: Mapping[str, Sequence[str]], name: str = "label") -> DataFrame:
    """(key, label) for each label a row carries whose markers all fail to appear in its text.

    Markers are compared as substrings after removing whitespace from the text; labels without markers
    are never reported.
    """
    t = compact(F.col(text))
    lab = F.col("__label")
    missing = F.lit(False)
    for label, ms in markers.items():
        if ms:
            none = F.lit(True)
            for m in ms:
                none = none & ~t.contains(m)
            missing = F.when(lab == label, none).otherwise(missing)
    ex = df.select(F.col(key), F.col(text), F.explode(F.col(labels)).alias("__label"))
    return ex.where(missing).select(key, lab.alias(name))
