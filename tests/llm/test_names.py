"""Stages and operators with columns that are named like what they use inside."""

from __future__ import annotations

import pytest
from helpers import corpus, documents
from pyspark.sql import functions as F

from grainline.llm import align, common, decontam, langid, mixing, periodic, simhash, tokens, toxicity

INSIDE = ["_h", "_all", "_none", "_n", "_first", "_id", "_source", "_key", "_copies", "_", "h", "fp", "c", "copies", "size", "m", "win", "w", "len", "place", "row", "pair", "words", "g", "a", "p", "rank", "held_out", "id"]


def clashing(df):
    return df.select(*[F.col(c) for c in ("doc_id", "text", "lang", "source", "n_chars")], *[F.lit(f"own {c}").alias(c) for c in INSIDE])


def test_unused(spark):
    df = spark.range(1).select(F.lit(1).alias("_H"), F.lit(1).alias("_h_"))
    assert common.unused(df, "_h", "x", "x") == ["_h__", "x", "x_"]


@pytest.mark.parametrize("stage", ["keep_one", "keep_one_once", "apply_mix", "drop_contaminated", "drop_toxic"])
def test_stages_keep_their_columns(spark, stage):
    docs = documents(spark, [(d, t, f"s{d % 3}") for d, t in corpus(3, 30)], clash=False)
    items = spark.createDataFrame([("i", " ".join(corpus(3, 30)[0][1].split()[:12]))], "item_id string, text string")
    model = toxicity.train(docs, docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))) if stage == "drop_toxic" else None
    run = {
        "keep_one": lambda d: simhash.keep_one(spark, d),
        "keep_one_once": lambda d: simhash.keep_one(spark, d, repeats=False),
        "apply_mix": lambda d: mixing.apply_mix(spark, d),
        "drop_contaminated": lambda d: decontam.drop_contaminated(spark, d, items),
        "drop_toxic": lambda d: toxicity.drop_toxic(spark, d, model),
    }[stage]
    plain, odd = run(docs), run(clashing(docs))
    assert odd.columns == clashing(docs).columns
    got = odd.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in plain.collect())
    assert all(r[c] == f"own {c}" for r in got for c in INSIDE)


def test_new_operators_ignore_them(spark):
    docs = documents(spark, corpus(4, 12), clash=False)
    for run in (lambda d: align.align(spark, d), lambda d: periodic.run_report(spark, d), lambda d: tokens.token_output(spark, d), lambda d: langid.identify(spark, d, langid.train(spark, d))):
        assert sorted(map(tuple, run(clashing(docs)).collect()), key=repr) == sorted(map(tuple, run(docs).collect()), key=repr)
