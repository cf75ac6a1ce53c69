from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from helpers import corpus, documents
from scales import SF_SMALL

from grainline.llm import periodic


def plain_runs(words):
    """Every period is tried, every stretch of equal words q apart is looked at."""
    out, stretches = [], set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= 4 * q and (i, j + q) not in stretches:
                stretches.add((i, j + q))
                if j + q - i >= 6:
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = [x for x in re.split("[\\x20\\x09-\\x0D]+", text or "") if x]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(x for i, x in enumerate(w) if i not in dropped))]
    return (doc_id, len(runs), *first, *digest)


def repeated(seed: int, n: int):
    """Texts of a few words with powers of powers, of all scales."""
    r, out = random.Random(seed), []
    for i in range(n):
        words: list[str] = []
        size = r.choice([0, 3, 6, 20, 60, 200, 900])
        alphabet = r.choice([1, 2, 3, 8, 40])
        while len(words) < size:
            unit = [f"w{r.randrange(alphabet)}" for _ in range(r.randint(1, 40))]
            if r.random() < 0.3:
                unit = unit * r.randint(2, 6) + ["x"]
            words += (unit * r.randint(1, 7))[: r.randint(1, 300)]
        out.append((i, r.choice([" ", "\n", " \t "]).join(words[:size])))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = repeated(seed, 150) + [(1000 + d, t) for d, t in corpus(seed, 60)]
    assert rows(periodic.run_report(spark, documents(spark, docs).repartition(3))) == sorted((plain_row(d, t) for d, t in docs), key=repr)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = sorted((plain_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)
    got = rows(periodic.run_report(spark, docs))
    assert got == want
    assert sum(r[1] for r in got) > 10


def test_texts_without_planting(spark):
    docs = [(1, "a b a b a b a b c"), (2, "x x x x x"), (3, "x x x x x x"), (4, "p q r p q r p q r p q")]
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_periodic_runs(documents(spark, docs)).collect()}
    assert got == {1: (9, [(0, 8, 2)], "a b c"), 2: (5, [], "x x x x x"), 3: (6, [(0, 6, 1)], "x"), 4: (11, [], "p q r p q r p q r p q")}


def test_edge_cases(spark):
    long = " ".join(["one two three four five"] * 30_000)
    docs = [(None, "a a a a a a"), (None, None), (5, ""), (5, " \n"), (9, long), (9, long), (7, "é " * 8), (8, "a\u00a0a a\u2003a")]
    got = rows(periodic.run_report(spark, documents(spark, docs)))
    assert len(got) == len(docs)
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r[1:6])
    assert sorted(by_id[None], key=repr) == [(0, None, None, None, None), (1, 0, 6, 1, 6000)]
    assert by_id[5] == [(0, None, None, None, None)] * 2
    assert by_id[9] == [(1, 0, 150_000, 5, 30_000_000)] * 2
    assert by_id[7] == [(1, 0, 8, 1, 8000)]
    assert by_id[8] == [(0, None, None, None, None)]
    assert periodic.run_report(spark, documents(spark, [])).collect() == []


def test_equal_hashes_lose_nothing(monkeypatch):
    """Names that collide propose more, never less, and proposals are compared word by word."""
    real = periodic._join
    texts = [t.encode().split() for _, t in repeated(3, 80)]
    monkeypatch.setattr(periodic, "_join", lambda names, width: real(names, width) % 7)
    got = periodic._runs_of_texts(texts)
    for i, words in enumerate(texts):
        assert got.get(i, []) == plain_runs(words)
