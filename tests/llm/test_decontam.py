from __future__ import annotations

import hashlib
import random
import re

from helpers import corpus, documents

from grainline.llm import decontam


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - size + 1)) if w else []:
            wins.setdefault(tuple(w[s : s + size]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for win, owners in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def got(spark, rows, items):
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, win int")
    return sorted((tuple(r) for r in decontam.decontaminate(spark, documents(spark, rows), frame).collect()), key=str)


def test_equals_brute_force(spark):
    r = random.Random(4)
    rows = corpus(21, 80, vocabulary=12)
    items = []
    for i in range(20):
        w = words(r.choice(rows)[1])
        a = r.randrange(max(1, len(w) - 5))
        items.append((i + 5, " ".join(w[a : a + r.choice([1, 2, 3, 9, 10, 11, 30])])))
    items += [(100, "wa0 " * 15), (101, items[0][1])]
    assert got(spark, rows, items) == brute(rows, items)


def test_edge_cases(spark):
    long = "lorem " * 30_000 + "A needle of exactly ten words that must be found here " + "ipsum " * 30_000
    rows = [(1, None), (2, ""), (None, "a b"), (3, long), (4, "Ünder_score-Éa 9x"), (4, "Ünder_score-Éa 9x"), (5, "b a\x00b"), (6, "...")]
    items = [(1, "a needle OF exactly ten words that must be found"), (2, None), (3, ""), (4, "A,B"), (5, "Ünder score"), (5, "Éa"), (None, "9X"), (7, "lorem lorem")]
    fixed = [(i if i is not None else 0, t) for i, t in items]
    assert got(spark, rows, fixed) == brute(rows, fixed)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == []
    assert got(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_drop_contaminated_judges_row_by_row(spark):
    item = "a needle of exactly ten words that must be found"
    rows = [(None, f"here {item} there"), (None, "clean one"), (None, "clean two"), (None, None), (7, item), (7, "clean seven"), (7, "clean seven"), (8, f"{item} {item}"), (9, "needle")]
    docs = documents(spark, rows)
    kept = decontam.drop_contaminated(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_pipeline_stage_keeps_clean_rows_of_a_contaminated_id(spark, monkeypatch):
    import corpus_pipeline

    item = "a needle of exactly ten words that must be found"
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: spark.createDataFrame([(1, item)], "item_id long, text string"))
    rows = [(None, item), (None, "clean"), (7, item), (7, "clean seven")]
    kept = corpus_pipeline.drop_contaminated(spark, documents(spark, rows), "")
    assert sorted((r.text for r in kept.collect())) == ["clean", "clean seven"]
