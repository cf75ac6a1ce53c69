from __future__ import annotations

import random

import numpy as np
from helpers import documents

from grainline.llm import toxicity


def labelled(seed, n):
    r = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    bad = ["idiot", "moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.2
        w = r.choices(plain, k=r.randint(5, 200))
        for _ in range(r.choice([1, 1, 2, 6]) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad).capitalize() + r.choice(["", "!", ","]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled(1, 1500)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, rows), frame)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    fresh, truth = labelled(2, 600)
    got = {r.doc_id: r for r in toxicity.score(documents(spark, fresh), model).collect()}
    assert all(got[i].rejected == bool(t) for i, _, t in truth)
    assert all(0 <= r.severity <= 2 and abs(r.severity - r.p_mild - r.p_severe) < 1e-9 for r in got.values())
    kept = toxicity.drop_toxic(spark, documents(spark, fresh), model)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, t in truth if not t}


def test_grades_share_weights():
    r = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(900):
        g = int(r.integers(0, 4))
        rows.append(np.unique(np.concatenate([r.integers(0, 50, 10), 1000 + r.integers(0, 4, 3 * g)])).astype(np.int32))
        y.append(g)
    m = toxicity.fit(rows, np.array(y))
    assert len(m.thresholds) == 3 and (np.diff(m.thresholds) > 0).all()
    mean = [np.mean([m.score(x).sum() for x, k in zip(rows, y, strict=True) if k == g]) for g in range(4)]
    assert mean == sorted(mean)


def test_bounded_sample(spark):
    rows, labels = labelled(3, 800)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, rows), frame, max_rows=300)
    got = toxicity.score(documents(spark, rows), model).collect()
    right = sum(r.rejected == bool(labels[r.doc_id][2]) for r in got)
    assert right > 0.97 * len(rows)


def test_edge_cases(spark):
    rows, labels = labelled(4, 400)
    frame = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (7, 1, labels[7][2])], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, rows), frame)
    odd = documents(spark, [(1, None), (2, ""), (None, "idiot"), (4, "idiot " * 100_000), (5, "word1"), (5, "word1")])
    got = sorted(((r.doc_id or 0, r.rejected) for r in toxicity.score(odd, model).collect()))
    assert got == [(0, True), (1, False), (2, False), (4, True), (5, False), (5, False)]
    assert toxicity.drop_toxic(spark, odd, model).count() == 4
    assert toxicity.score(documents(spark, []), model).collect() == []
    none = toxicity.train(documents(spark, []), frame)
    assert {r.severity for r in toxicity.score(odd, none).collect()} == {0.0}
