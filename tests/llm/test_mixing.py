from __future__ import annotations

import random

from helpers import documents
from pyspark.sql import functions as F

from grainline.llm import mixing


def reshare(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by resharing what is above the caps, round after round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, left, out = set(names), share * sum(sizes.values()), {}
    while open_:
        total = sum(w[s] for s in open_)
        above = [s for s in open_ if w[s] * left / total > cap * sizes[s]]
        if not above:
            out |= {s: w[s] * left / total for s in open_}
            break
        for s in above:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_targets_and_samples(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * int(r.expovariate(0.02))), r.choice(["a", "a", "a", "a", "b", "é", "Z", None])) for i in range(900)]
    docs = documents(spark, rows)
    got = mixing.mix(spark, docs).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = reshare(sizes)
    source = {i: s for i, _, s in rows}
    taken: dict = {}
    for x in got:
        assert abs(x.target - want[source[x.doc_id]]) < 1e-6 and x.source_size == sizes[source[x.doc_id]]
        assert x.taken == x.copies * x.size and 0 <= x.copies <= 2
        taken[source[x.doc_id]] = taken.get(source[x.doc_id], 0) + x.taken
    longest = max(len(t.split()) for _, t, _ in rows)
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= longest for s in want)
    again = mixing.mix(spark, docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    mixed = mixing.apply_mix(spark, docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(x.copies for x in got)


def test_weights_make_unequal_copies(spark):
    rows = [(i, "w " * (10 + i % 5), "a" if i % 3 else "b") for i in range(600)]
    docs = documents(spark, rows).withColumn("good", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    got = mixing.mix(spark, docs, weight=F.col("good")).collect()
    even = sum(x.copies for x in got if x.doc_id % 2 == 0)
    odd = sum(x.copies for x in got if x.doc_id % 2)
    assert even > 1.3 * odd and max(x.copies for x in got) <= 2
    for s in ("a", "b"):
        mine = [x for x in got if ("a" if x.doc_id % 3 else "b") == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= 14


def test_rows_of_one_id_are_drawn_apart(spark):
    r = random.Random(4)
    rows = [(None if i % 2 else 7, " ".join(r.choices("abcdefgh", k=20)), "a" if i % 3 else "b") for i in range(900)]
    got = mixing.mix(spark, documents(spark, rows)).collect()
    for target in {x.target for x in got}:
        mine = [x for x in got if x.target == target]
        assert abs(sum(x.taken for x in mine) - target) <= 20
        for some in ([x for x in mine if x.doc_id is None], [x for x in mine if x.doc_id == 7]):
            share = sum(x.copies for x in some) / len(some)  # both ids near the share of all, none as a block
            assert abs(share - target / mine[0].source_size) < 0.15


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "x y", "a"), (3, "x y", "a"), (3, "x y", "a"), (3, "z", "b"), (4, "w " * 5000, "b")]
    got = mixing.mix(spark, documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(x.doc_id, x.size) for x in got} == {(1, 0), (2, 0), (None, 2), (3, 2), (3, 1), (4, 5000)}
    assert all(x.taken <= 2 * x.size for x in got)
    assert len({x.copies for x in got if x.doc_id == 3 and x.size == 2}) == 1  # equal rows go together


def test_no_documents(spark):
    assert mixing.mix(spark, documents(spark, [])).collect() == []
    assert mixing.mix(spark, documents(spark, [(1, "", "a")])).collect()[0].taken == 0
