from __future__ import annotations

import corpus_pipeline
import pytest

from grainline.llm import decontam, queries, simhash, toxicity
from grainline.llm.common import Scratch, components, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, scratch = docs.columns, Scratch(spark, "test")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append(docs.count())
    toxic = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert toxicity.score(docs, toxic).where("rejected").isEmpty()
    once = docs.dropDuplicates(["doc_id"])
    assert simhash.near_duplicates(spark, once).where("component_id <> doc_id").isEmpty()
    assert decontam.decontaminate(spark, once, table(spark, SF, "benchmark")).where("contaminated").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() == seen[-1]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last.collect()))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_queries_run(spark, name):
    got = queries.QUERIES[name](spark, SF)
    n = table(spark, SF, "pages" if name.startswith("op5") else "documents").count()
    assert got.count() == n or name.startswith("op2")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, duck_small, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck_small.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert got[cols].sort_values(cols).values.tolist() == want[cols].sort_values(cols).values.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 150)] + [(300, 301 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    want = dict.fromkeys(range(2, 41), 1) | {95: 90, 100: 90, 200: 150} | {301 + i: 300 for i in range(50)}
    assert got == want
