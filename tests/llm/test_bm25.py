from __future__ import annotations

import math
from collections import Counter

from helpers import corpus, documents

from grainline.llm import bm25


def brute(rows, queries, k):
    docs = [(d, Counter(w.decode() for w in bm25.terms_of(t.encode()))) for d, t in rows]
    mean = sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    out = {}
    for q, text in queries:
        scored = []
        for d, c in docs:
            s = 0.0
            for w, n in Counter(x.decode() for x in bm25.terms_of(text.encode())).items():
                if c[w]:
                    norm = bm25.K1 * (1 - bm25.B + bm25.B * sum(c.values()) / mean)
                    s += n * math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (bm25.K1 + 1) / (c[w] + norm)
            if s > 0:
                scored.append((-round(s, 9), d))
        out[q] = sorted(scored)[:k]
    return out


def test_equals_brute_force_over_shards(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_BYTES", 3000)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    monkeypatch.setattr(bm25, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(bm25, "QUERY_TERMS", 40)
    rows = corpus(3, 90, vocabulary=200)
    queries = rows[::9]
    q = spark.createDataFrame(queries, "query_id long, text string")
    got: dict = {}
    for r in bm25.search(spark, documents(spark, rows), q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 9), r.doc_id))
    want = brute(rows, queries, 5)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_edge_cases(spark):
    long = "alpha " * 50_000
    rows = [(100, "alpha beta"), (200, None), (300, ""), (None, "alpha"), (4, "beta"), (4, "beta"), (5, long), (400, "nothing else")]
    got = [(r.query_id, r.rank, r.doc_id) for r in bm25.search_by_documents(spark, documents(spark, rows), k=4).orderBy("query_id", "rank").collect()]
    # queries without a word have no result; rows without an id are left out; repeated ids are results of their own
    assert got == [(100, 1, 100), (100, 2, 5), (100, 3, 4), (100, 4, 4), (400, 1, 400)]


def test_no_documents(spark):
    assert bm25.search_by_documents(spark, documents(spark, [])).collect() == []


def test_thresholds_prune_and_lose_nothing(monkeypatch):
    """Whatever the blocks, the dense lists and the thresholds, the best k are those of scoring everything."""
    import numpy as np

    r = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in np.minimum(r.zipf(1.6, r.integers(1, 60)), 200)).encode() for _ in range(600)]
    order = bm25.alike(texts)
    keys, start, doc, tf, length = bm25.postings([texts[i] for i in order])
    blob = bm25.pack(ids=order, keys=keys, start=start, doc=doc.astype(np.uint16), tf=tf, length=length)
    norm = tf + bm25.K1 * (1 - bm25.B + bm25.B * length[doc] / length.mean())
    weight = tf * (bm25.K1 + 1) / norm
    queries, want = [], []
    for q in range(0, 600, 7):
        k_keys, _, _, qtf, _ = bm25.postings([texts[q]])
        gain = qtf * r.uniform(0.1, 3, len(k_keys))
        full = np.zeros(600)
        for key, g in zip(k_keys, gain, strict=True):
            at = np.searchsorted(keys, key)
            full[doc[start[at] : start[at + 1]]] += g * weight[start[at] : start[at + 1]]
        queries.append((k_keys, gain))
        want.append(bm25.best_of(order[np.flatnonzero(full > 0)], full[full > 0], 5))
    for block, dense in ((1, 16), (4, 1), (32, 10**6), (1000, 16)):
        monkeypatch.setattr(bm25, "BLOCK", block)
        monkeypatch.setattr(bm25, "DENSE", dense)
        shard = bm25.Shard(blob, float(length.mean()))
        for share in (0.0, 0.9, 1 - 1e-12):
            for (got, found), (ids, score) in zip(shard.search(queries, 5, [s[-1] * share for _, s in want]), want, strict=True):
                assert np.allclose(found, score) and (np.isclose(score[:-1], score[1:]).any() or got.tolist() == ids.tolist())


def test_order_of_texts_keeps_no_words(monkeypatch):
    """The words of all texts at once take about ten times their bytes."""
    import tracemalloc

    texts = [" ".join(f"{i}a{j % 50}" for j in range(2000)).encode() for i in range(100)]
    tracemalloc.start()
    order = bm25.alike(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(order.tolist()) == list(range(100))
    assert peak < sum(map(len, texts)) / 2


def test_one_shard_at_a_time(spark, monkeypatch):
    """A task frees a shard before it reads the next one."""
    import weakref

    import numpy as np
    import pyarrow as pa

    alive, kinds = [], []
    init = bm25.Shard.__init__

    def watched(self, blob, mean):
        kinds.append(sum(r() is not None for r in alive))
        init(self, blob, mean)
        alive.append(weakref.ref(self))

    monkeypatch.setattr(bm25.Shard, "__init__", watched)
    blobs = [bm25._index_of([i], [b"alpha beta"]).column("blob")[0].as_py() for i in range(3)]
    keys, _, _, _, _ = bm25.postings([b"alpha"])
    batch = pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["blob"])
    (found,) = bm25.search_shards(iter([batch]), (np.full(1, 100), keys, np.ones(1)), 2.0, 2)
    assert kinds == [0, 0, 0] and found.column("doc_id").to_pylist() == [0, 1]


def test_lead_shards_lose_nothing(spark, monkeypatch):
    """Whether all, some or no shards are searched first, the best are those of scoring everything."""
    monkeypatch.setattr(bm25, "SHARD_BYTES", 1500)
    monkeypatch.setattr(bm25, "QUERY_TERMS", 100)
    rows = corpus(5, 80, vocabulary=120)
    queries = rows[::6]
    want = brute(rows, queries, 4)
    for lead in (1, 3, 1 << 40):
        monkeypatch.setattr(bm25, "LEAD", lead)
        got: dict = {}
        for r in bm25.search(spark, documents(spark, rows).coalesce(2), spark.createDataFrame(queries, "query_id long, text string"), 4).collect():
            got.setdefault(r.query_id, []).append((-round(r.score, 9), r.doc_id))
        assert {q: sorted(x) for q, x in got.items()} == want


def _searched(n_shards: int, n_docs: int, n_queries: int, k: int, same: str = ""):
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(8)
    texts = [" ".join([*(f"w{int(x)}" for x in np.minimum(r.zipf(1.4, r.integers(20, 90)), 3000))]).encode() for _ in range(n_shards * n_docs)]
    if same:
        texts[1::n_docs] = [same.encode()] * n_shards
    blobs = [bm25._index_of(list(range(-i - n_docs, -i)), texts[i : i + n_docs]).column("blob")[0].as_py() for i in range(0, n_shards * n_docs, n_docs)]
    q, key, gain = [], [], []
    for i in range(n_queries):
        keys, _, _, tf, _ = bm25.postings([same.encode() if same and i == 0 else texts[i * 7 % len(texts)]])
        q.append(np.full(len(keys), i))
        key.append(keys)
        gain.append(tf * r.uniform(0.1, 3, len(keys)))
    batch = pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], ["blob"])
    return lambda: pa.Table.from_batches(bm25.search_shards(iter([batch]), (*(np.concatenate(x) for x in (q, key, gain)),), 55.0, k))


def test_queries_are_searched_together():
    """A shard's work is done for groups of queries, not with dozens of calls for each query."""
    import cProfile
    import pstats

    search = _searched(6, 400, 300, 3)
    profile = cProfile.Profile()
    profile.runcall(search)
    assert pstats.Stats(profile).total_calls < 20 * 6 * 300


def test_same_texts_score_the_same():
    """Whatever lists their shards lay out densely: the order of ties is that of the ids."""
    same = " ".join(f"w{i} x{i % 7}" for i in range(1, 40))
    found = _searched(8, 60, 20, 8, same)()
    first = [(d, s) for q, d, s in zip(*(c.to_pylist() for c in found.columns), strict=True) if q == 0]
    assert len({s for _, s in first}) == 1 and [d for d, _ in first] == sorted(-60 * i + 1 - 60 for i in range(8))


def test_words_counted_at_once():
    texts = [b"", None, b"a", b" a a  b ", bytes(range(256)) * 2, "A a\u0085B.c_d \u00a0x\u2028y".encode(), b"b a b a"]
    counts = bm25.count(texts)
    for i, t in enumerate(texts):
        of = counts.doc == i
        got = {counts.words[w]: n for w, n in zip(counts.word[of].tolist(), counts.tf[of].tolist(), strict=True)}
        assert got == Counter(bm25.terms_of(t)) and counts.length[i] == len(bm25.terms_of(t))
    assert bm25.alike(texts, counts).tolist() == bm25.alike(texts).tolist()
