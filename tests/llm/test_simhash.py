from __future__ import annotations

import random

import numpy as np
import xxhash
from helpers import corpus, documents
from pyspark.sql import functions as F

from grainline.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Component of every node by comparing all pairs."""
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_equals_brute_force(spark):
    rows = [*corpus(11, 120), (10_001, "one two"), (10_002, "Ünï Çode ÀB\x85x y cc"), (10_003, "... ,,"), (10_004, "x" * 100_000)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark, documents(spark, rows)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    comp = groups(prints)
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i in prints}


def test_spark_hash_is_the_same(spark):
    text = "Some words, with ünïcode"
    low = "some words, with ünïcode"
    grams = ["some words, with", "words, with ünïcode"]
    got = spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()
    assert [r[0] & (2**64 - 1) for r in got] == [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    assert simhash.fingerprint(text) == simhash.fingerprint(low)


def test_links_of_dense_blocks(monkeypatch, spark):
    r = random.Random(2)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 300:  # a chain of near fingerprints and strangers
        f = r.choice(sorted(fps)) if r.random() < 0.9 else r.getrandbits(64)
        for _ in range(r.randint(1, 4)):
            f ^= 1 << r.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    want = groups(dict(enumerate(fps)))
    a, b = simhash.links(np.zeros(len(fps), dtype=np.int64), np.array(fps, dtype=np.uint64))
    nodes = {i: i for i in range(len(fps))}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert want[x] == want[y]
        nodes[x] = min(nodes[x], y)
    # the whole operator with blocks cut into pieces of 8
    monkeypatch.setattr(simhash, "BLOCK", 8)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, n: docs.select("doc_id", F.col("n_chars").alias("fp")))
    docs = spark.createDataFrame([(i, "", "en", "s", f) for i, f in signed], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark, docs).collect()}
    assert got == want


def test_edge_cases(spark):
    rows = [(9, None), (2, ""), (5, " \t "), (None, "only here and nowhere else"), (7, "p q r s t"), (7, "p q r s t"), (8, "p q r s t")]
    docs = documents(spark, rows)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(spark, docs).collect()), key=str)
    assert got == sorted([(False, 9, 2), (False, 2, 2), (False, 5, 2), (True, 0, None), (False, 7, 7), (False, 7, 7), (False, 8, 7)], key=str)
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 7, 7]


def test_no_documents(spark):
    assert simhash.near_duplicates(spark, documents(spark, [])).collect() == []


def test_keep_one_row_of_each_component(spark):
    r = random.Random(12)
    rows = [(i if i % 3 else None, t) for i, t in corpus(13, 90)]
    rows += [(r.choice(rows)[0], t) for _, t in r.choices(rows, k=30)]  # ids repeat over texts
    rows += r.choices(rows, k=30)  # repeated rows
    rows += [(None, "nobody has an id"), (None, "nobody has an id"), (7, "same row"), (7, "same row"), (7, "another text of seven"), (1, "another text of seven")]

    def order(row):
        i, text = row
        h = 42 if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(text.encode(), h)
        return i is None, i or 0, h - (h >> 63 << 64)

    comp = groups({k: plain_fingerprint(t) for k, (_, t) in enumerate(rows)})
    want = [min((rows[k] for k in comp if comp[k] == c), key=order) for c in set(comp.values())]
    docs = documents(spark, rows)
    kept = simhash.keep_one(spark, docs, repeats=False)
    assert kept.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted(want, key=str)
    assert sorted(set((x.doc_id, x.text) for x in simhash.keep_one(spark, docs).collect()), key=str) == sorted(want, key=str)


def test_rows_that_differ_beside_id_and_text(spark):
    docs = spark.createDataFrame([(3, "one text here", s) for s in ("a", "b", "a", None)], "doc_id long, text string, source string")
    assert simhash.keep_one(spark, docs, repeats=False).count() == 1
