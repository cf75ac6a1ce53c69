from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from helpers import corpus, documents

from grainline.llm import tokens
from grainline.llm.common import Scratch

ODD = [
    "two  spaces and   three", " leading", "trailing ", "tab\there \n new\n\n lines \n", "it's <|endoftext|> special", "é à  nbsp   em", "a \x1c b \x85 c", "1234 $%^ don't we'll", "", "\n", " ", "  ",
    "emoji 😀 ok 日本語 テスト", "x" * 50_000,
]


def test_equals_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    rows = [*corpus(2, 40), *[(1000 + i, t) for i, t in enumerate(ODD)]]
    got = sorted(map(tuple, tokens.token_output(spark, documents(spark, rows).repartition(5)).collect()))
    at, want = 0, []
    for d, t in sorted(rows):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_files_and_pruned_reads(spark):
    path = Scratch(spark, "test").path()
    rows = [(i, f"text number {i}") for i in range(500)]
    tokens.write_tokens(documents(spark, rows), path, public_tokenizers.path(tokens.VOCABULARY))
    whole = tokens.read_tokens(spark, path)
    some = tokens.read_tokens(spark, path, [7, 311])
    assert whole.count() == 500
    assert sorted(r.doc_id for r in some.collect()) == [7, 311]
    assert {tuple(r.ids) for r in some.collect()} == {tuple(r.ids) for r in whole.where("doc_id in (7, 311)").collect()}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


def test_edge_cases(spark):
    rows = [(5, None), (None, "a"), (5, "b"), (2, ""), (2, "")]
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in tokens.token_output(spark, documents(spark, rows)).collect()))
    assert got == [(0, None, 2), (2, 2, 1), (3, 2, 1), (4, 5, 1), (5, 5, 2)]
    assert tokens.token_output(spark, documents(spark, [])).collect() == []


def _rows_out_of_scans(df) -> int:
    """Rows that the file scans of a frame's plan returned in its last run."""

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if "QueryStageExec" in node.getClass().getSimpleName():
            return walk(node.plan())
        n = node.metrics().get("numOutputRows").get().value() if node.nodeName().startswith("Scan orc") and "text" not in node.nodeName() else 0
        children = node.children()
        return n + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_row_groups_are_skipped(spark):
    """Statistics and Bloom filters leave out row groups: of 20,000 even ids in one file, an odd one reads no row."""
    path = Scratch(spark, "test").path()
    rows = spark.range(20_000).selectExpr("id * 2 as doc_id", "concat('text ', id) as text", "'x' as place").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        tokens.write_tokens(rows, path, public_tokenizers.path(tokens.VOCABULARY))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    files = spark.read.schema(tokens.SCHEMA).orc(path)
    for ids, most in (([8], tokens.ROW_STRIDE), ([9], 0), ([8, 39_998], 2 * tokens.ROW_STRIDE), ([1, 3, 20_001], 0)):
        some = files.where(files.doc_id.isin(ids))
        assert some.count() == sum(i % 2 == 0 for i in ids)
        found = some.select("doc_id", "n_tokens")
        found.collect()
        assert _rows_out_of_scans(found) <= most


def test_a_hot_id_is_cut(spark):
    """An id that holds most rows, equal ones among them, does not make one large file."""
    rows = [(None if i % 10 else i, f"text {i % 7} {'x ' * (i % 3)}" if i % 2 else "the same") for i in range(4000)]
    docs = documents(spark, rows).repartition(6)
    path = Scratch(spark, "test").path()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    try:
        tokens.write_tokens(docs, path, public_tokenizers.path(tokens.VOCABULARY))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in spark.read.schema(tokens.SCHEMA).orc(path).groupBy("shard").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500
    got = [tuple(r) for r in tokens.digest(tokens.read_tokens(spark, path)).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]


def test_words_of_runs(spark):
    """Words that go to the merges run by run have the ids of the whole encoder."""
    enc = tokens.encoder(public_tokenizers.path(tokens.VOCABULARY))
    words = ["don't", "we'll.", "élève,", "Ñandú!!!", "end.\nStart", "end\nStart,", "a\nb\nc", "x.\n", "\nx", "a1b", "_x_", "it's''", "ﬁx", "übeŕ", "×3", "ÿÿ***", "a\r\nb", "'s", "s's", "A" * 400 + "?!", "tab\tx", "ab,cd"]
    for w in words:
        for text in (w, f"a {w}", f"a {w} {w}.", f"{w}\n{w}"):
            assert enc.encode(text) == enc._whole(text), text


def test_encode_all_looks_each_distinct_word_up_once():
    enc = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    special = enc.special[0]
    texts = ["", " ", "a\nb", "Ab, cd.\nEf cd.\ncd.", "a\n\nb  c", "\nx", "x\n", "a\tb 　c", f"p {special} q", "it's 12 été\x00 \x85", "the " * 50 + "end"]
    met = []
    get, enc.__class__ = enc.__class__.__getitem__, type("Counting", (tokens.Encoder,), {"__getitem__": lambda self, k: met.append(k) or get(self, k)})
    ids, n = enc.encode_all(texts)
    want = [[*e.ids, tokens.END_ID] for e in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
    assert met.count("the") == 1
