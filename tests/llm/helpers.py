"""Small frames for the tests of grainline.llm."""

from __future__ import annotations

import random

#: Columns beside the usual ones whose names the operators use inside.
CLASH = "key string, h long, p long, w string, block int, n long, fp long, component string, words long, pos int"


def documents(spark, rows, clash: bool = True):
    """``rows`` of (doc_id, text[, source]); the other columns of documents and clashing ones are filled in."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if clash:
        full = [(*r, "k", 7, 7, "w", 7, 7, 7, "c", 7, 7) for r in full]
        schema = f"{schema}, {CLASH}"
    return spark.createDataFrame(full, schema)


def corpus(seed: int, n: int = 60, vocabulary: int = 30, words: int = 40) -> list[tuple[int, str]]:
    """Random texts with shared passages, exact and near copies."""
    r = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{i}" for i in range(vocabulary)]
    passage = [" ".join(r.choices(vocab, k=14)) for _ in range(5)]
    out: list[tuple[int, str]] = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.15:
            text = r.choice(out)[1]
        elif out and kind < 0.3:
            t = r.choice(out)[1].split(" ")
            t[r.randrange(len(t))] = r.choice(vocab)
            text = " ".join(t)
        else:
            parts = [" ".join(r.choices(vocab, k=r.randint(1, words))) for _ in range(r.randint(1, 4))]
            if r.random() < 0.4:
                parts.insert(r.randrange(len(parts) + 1), r.choice(passage))
            text = r.choice(["\n", " ", ".  "]).join(parts)
        out.append((i * 7, text))
    return out
