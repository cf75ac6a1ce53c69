from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import corpus, documents

from grainline.llm import lm


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


class Plain:
    """The same model with dictionaries, symbol by symbol."""

    def __init__(self, texts, order):
        self.order = order
        self.n = [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            seq = [lm.START] * order + list(t) + [lm.END]
            for i in range(order, len(seq)):
                for o in range(order + 1):
                    self.n[o][tuple(seq[i - o : i])][seq[i]] += 1

    def p(self, ctx, s):
        out, gone = 1.0, set()
        for o in range(self.order, -1, -1):
            seen = self.n[o].get(tuple(ctx[len(ctx) - o :]))
            if not seen:
                continue
            rest = {x: c for x, c in seen.items() if x not in gone}
            total = sum(rest.values()) + len(rest)
            if s in rest:
                return out * rest[s] / total
            if rest:
                out *= len(rest) / total
            gone |= seen.keys()
        return out / (256 - len(gone))

    def log10(self, t):
        seq = [lm.START] * self.order + list(t) + [lm.END]
        return sum(math.log10(self.p(seq[i - self.order : i], seq[i])) for i in range(self.order, len(seq)))


def test_equals_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(lm, "STEP", 700)
    rows = [*corpus(8, 50), (5001, "Zebra ÀÉ unseen\x85bytes"), (5002, "")]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    assert 0 < sum(held.values()) < len(rows)
    train = [low(t) for d, t in rows if not held[d]]
    model = Plain([b" ".join(w) for w in train], lm.ORDER)
    count = Counter(w for t in train for w in [*t, None])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.score_documents(spark, documents(spark, rows)).collect()}
    for d, t in rows:
        w = low(t)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d], len(w) + 1, n)
        assert r.n_known == sum(count[x] > 0 for x in [*w, None])
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in [*w, None]), rel_tol=1e-9)
        assert math.isclose(r.score, model.log10(b" ".join(w)), rel_tol=1e-9)


def test_probabilities_add_up():
    r = np.random.default_rng(3)
    gram = np.unique(r.integers(97, 100, (400, lm.ORDER + 1)) @ (256 ** np.arange(lm.ORDER + 1)))
    n = r.integers(0, 5, len(gram))
    low_counts = np.zeros((256, 256), dtype=np.int64)
    for g, k in zip(gram, n, strict=True):
        low_counts[(g >> 8) & 255, g & 255] += k
    for ctx in np.unique(gram >> 8)[:5]:
        every = np.concatenate([gram, (ctx << 8) + np.arange(256)])
        counts = np.concatenate([n, np.zeros(256, dtype=n.dtype)])
        p = lm.log_probabilities(every, counts, low_counts)[len(gram) :]
        assert math.isclose((10**p).sum(), 1.0, rel_tol=1e-9)


def test_edge_cases(spark):
    held = [d for d in range(1, 200) if zlib.crc32(str(d).encode()) % 7 == 2]
    a, b, c = [d for d in range(1, 9) if d not in held][:3]
    rows = [(a, None), (None, "a b"), (b, "x " * 60_000), (c, "same"), (c, "same")]
    got = sorted(((r.doc_id or 0, r.held_out, r.n_tokens, round(r.score, 6)) for r in lm.score_documents(spark, documents(spark, rows)).collect()))
    assert [g[:3] for g in got] == [(0, False, 3), (a, False, 1), (b, False, 60_001), (c, False, 2), (c, False, 2)]
    assert got[3] == got[4]
    assert lm.score_documents(spark, documents(spark, [])).collect() == []
    (r,) = lm.score_documents(spark, documents(spark, [(held[0], "ab")])).collect()
    assert r.base_score == 0 and math.isclose(r.score, 3 * math.log10(1 / 256)) and (r.n_known, r.train_tokens) == (0, 0)


def test_merged_grams_and_a_block_take_little_beside_them():
    import tracemalloc

    r = np.random.default_rng(2)
    u, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    want: dict[int, int] = {}
    for weight in (1, 0, 1, 1, 0):
        g = r.integers(0, 60, 40).astype(np.uint64)
        u, n = lm._merge(u, n, g, weight)
        for x in g.tolist():
            want[x] = want.get(x, 0) + weight
    assert dict(zip(u.tolist(), n.tolist(), strict=True)) == want and u.tolist() == sorted(want)

    u, n = np.arange(1 << 20, dtype=np.uint64), np.ones(1 << 20, dtype=np.int64)
    g = np.arange(10, dtype=np.uint64)
    tracemalloc.start()
    lm._merge(u, n, g, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * u.nbytes  # the new arrays, a copy of the counts and a mask; a sort of both takes eight times it


def test_join_sends_a_block_one_row_for_many_keys(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm, "GATHERED", 700)
    r = np.random.default_rng(5)
    rows = pa.table({"block": r.integers(0, 3, 2000) << 40, "key": r.integers(0, 1 << 62, 2000), "value": r.integers(0, 1 << 40, 2000)})
    got = pa.Table.from_batches(lm.gather(iter(rows.to_batches(max_chunksize=100))))
    assert got.num_rows == 9  # three times 700 rows of three blocks
    for k in range(3):
        mine = got.filter(pa.compute.equal(got["block"], k << 40))
        want = rows.filter(pa.compute.equal(rows["block"], k << 40))
        assert sorted(zip(lm.gathered(mine, "keys").tolist(), lm.gathered(mine, "values").tolist(), strict=True)) == sorted(zip(want["key"].to_pylist(), want["value"].to_pylist(), strict=True))
    assert list(lm.gather(iter(rows.slice(0, 0).to_batches()))) == []


def test_counting_a_block_takes_little_beside_its_text():
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(6)
    text = b" ".join(f"w{x}".encode() for x in r.integers(0, 3000, 400_000))
    blob = pa.py_buffer(pa.compress(text, codec="zstd", asbytes=True))
    tracemalloc.start()
    keys, counts = lm._dictionary([False], [len(text)], blob, lm.ORDER)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(keys) == len(np.unique(keys)) and counts[keys >= lm.WORD].sum() == 400_001 and counts[keys < lm.WORD].sum() == len(text) + 1
    assert peak < 100 << 20


def test_texts_of_a_block_are_never_there_at_once():
    import tracemalloc

    import pyarrow as pa

    texts = [bytes([97 + i % 26]) * (i % 3) * 300_000 for i in range(60)]
    blob = pa.py_buffer(pa.compress(b"".join(texts), codec="zstd", asbytes=True))
    sizes = [len(t) for t in texts]
    tracemalloc.start()
    used = pa.total_allocated_bytes()
    for t, want in zip(lm.unpack(sizes, blob), texts, strict=True):
        assert t == want
        assert pa.total_allocated_bytes() - used < 4 << 20
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(sizes) / 8
    assert list(lm.unpack([0, 0], pa.py_buffer(pa.compress(b"", codec="zstd", asbytes=True)))) == [b"", b""]
