from __future__ import annotations

import random

from helpers import documents

from grainline.llm import line_dedup


def brute(rows, min_words):
    """Lines inside an earlier-copied run of enough words, by comparing all positions."""
    seq = [(d, i, line) for d, t in sorted(rows) for i, line in enumerate((t or "").split("\n"))]
    gone = set()
    for a in range(len(seq)):
        for b in range(a):
            if a and b and seq[a - 1][0] == seq[a][0] and seq[b - 1][0] == seq[b][0] and seq[a - 1][2] == seq[b - 1][2]:
                continue  # not the start of a common run
            n = 0
            while a + n < len(seq) and seq[a + n][0] == seq[a][0] and seq[b + n][0] == seq[b][0] and seq[a + n][2] == seq[b + n][2]:
                n += 1
            if sum(len(seq[a + k][2].split()) for k in range(n)) >= min_words:
                gone |= {seq[a + k][:2] for k in range(n)}
    return {d: "\n".join(x for e, i, x in seq if e == d and (e, i) not in gone) for d, _ in rows}


def test_runs_equal_brute_force(spark):
    r = random.Random(5)
    lines = [" ".join(r.choices("abcdef", k=r.randint(0, 4))) for _ in range(12)]
    rows = [(i, "\n".join(r.choices(lines, k=r.randint(1, 14)))) for i in range(25)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    for least in (1, 9):
        got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark, documents(spark, rows), least).collect()}
        assert got == brute(rows, least)


def test_edge_cases(spark):
    long = "\n".join(f"line number {i} of a very long text" for i in range(3000))
    rows = [(3, None), (1, ""), (None, long), (5, long), (7, "same words here"), (7, "same words here"), (8, "same words here\nother")]
    got = sorted(((x.doc_id if x.doc_id is not None else -1, x.n_lines, x.n_removed, len(x.text)) for x in line_dedup.dedup_lines(spark, documents(spark, rows), 3).collect()))
    # a null id comes first; equal rows of one id are one document; the later copy of the long text goes whole
    assert got == [(-1, 3000, 0, len(long)), (1, 1, 0, 0), (3, 1, 0, 0), (5, 3000, 3000, 0), (7, 1, 0, 15), (7, 1, 0, 15), (8, 2, 1, 5)]


def test_repeats_inside_one_document(spark):
    rows = [(1, "\n".join(["x y"] * 50)), (2, "a")]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark, documents(spark, rows), 2).collect()}
    assert got == {1: "x y", 2: "a"}


def test_no_documents(spark):
    assert line_dedup.dedup_lines(spark, documents(spark, [])).collect() == []
