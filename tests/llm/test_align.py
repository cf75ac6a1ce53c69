from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import corpus, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from scales import SF_SMALL

from grainline.llm import align
from grainline.llm.perfect_hash import PerfectHash, build, shard_of

PATHS = (public_tokenizers.path(align.VOCABULARY_A), public_tokenizers.path(align.VOCABULARY_B))
ODD = [
    "two  spaces and   three", " leading", "trailing ", "   ", " ", "tab\there \n new\n\n  lines \n  x", "it's <|endoftext|> plain </s> <s> <unk> <0x41>", "é à nbsp  em", "a \x1c b \x85 c\x00d",
    "under▁score ▁ x", "▁", "emoji 😀 ok 日本語 テスト", "x" * 3000, "日" * 1500, "a　b 　 c", "\r\n \r\n", "1234 $%^ don't we'll", "﻿bom", "é ﬁ Å",
]


@pytest.fixture(scope="module")
def plain():
    """Whole texts, token by token, byte by byte."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    byte = align.byte_of_character()

    def one(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return None
        links, groups = [], []
        i = j = at = end_a = end_b = 0
        group = ([], [])
        while i < len(ids_a) or j < len(ids_b):  # byte by byte boundaries of both
            if end_a == at:
                group[0].append(ids_a[i])
                end_a += len(bytes_a[i])
                i += 1
            if end_b == at:
                group[1].append(ids_b[j])
                end_b += len(bytes_b[j])
                j += 1
            links.append((ids_a[i - 1], ids_b[j - 1]))
            at = min(end_a, end_b)
            if end_a == end_b:
                groups.append(group)
                group = ([], [])
        return ids_a, ids_b, groups, links

    def rows(docs):
        found = [one(t) for _, t in docs]
        count = Counter(p for f in found if f for p in set(f[3]))
        top = {}
        for (x, _), n in count.items():
            top[x] = max(n, top.get(x, 0))
        out = []
        for (d, _), f in zip(docs, found, strict=True):
            if f is None:
                out.append((d, 0, 0, 0, 0, 0, 0, ""))
                continue
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
            best = sum(count[p] == top[p[0]] for p in f[3])
            out.append((d, len(f[0]), len(f[1]), len(f[2]), len(f[3]), best, sum(count[p] for p in f[3]), hashlib.sha256(text.encode()).hexdigest()))
        return sorted(out, key=repr)

    return rows


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("limit", [align.BROADCAST_BYTES, 0])
def test_equals_whole_text_tokens(spark, plain, limit, monkeypatch):
    docs = corpus(5, 60) + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs += [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(80).collect()]
    for name, small in (("SHARD_PAIRS", 200), ("ROWS_A_VECTOR", 40), ("ROWS_A_SALT", 20), ("FAN_IN", 3)):
        monkeypatch.setattr(align, name, small)
    got = rows(align.align(spark, documents(spark, docs).repartition(11), broadcast_bytes=limit))
    assert got == plain(docs)


@pytest.mark.parametrize("limit", [align.BROADCAST_BYTES, 0])
def test_edge_cases(spark, plain, limit):
    docs = [(None, "same text"), (None, None), (3, ""), (4, "same text"), (4, "same text"), (4, "other " * 20_000)]
    assert rows(align.align(spark, documents(spark, docs), broadcast_bytes=limit)) == plain(docs)
    assert align.align(spark, documents(spark, []), broadcast_bytes=limit).collect() == []
    assert rows(align.align(spark, documents(spark, [(1, None)]), broadcast_bytes=limit)) == [(1, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab' \n\t \x1c.é日1▁")), max_size=30), min_size=1, max_size=4))
def test_pieces_are_whole_texts(texts):
    """Cutting texts at spaces changes no token."""
    p = align._pieces(*PATHS)
    numbers, starts = p.numbers(texts)
    for k, t in enumerate(texts):
        mine = numbers[starts[k] : starts[k + 1]]
        whole = p._align([t], False) if t else None
        assert (whole is None) == (not len(mine) or bool(p.wrong[mine].any()))
        if whole:
            assert p.counts[mine].sum(axis=0).tolist() == whole[0][0].tolist()
            assert ";".join(p.group_texts()[i] for i in mine) == "".join(map(p.strings.__getitem__, whole[2].tolist()))


def test_ranks_are_merges():
    """The faster encoder finds the ids of the vocabulary file's own library."""
    p = align._pieces(*PATHS)
    words = sorted({w for _, t in corpus(9, 40) for w in t.split()} | {"élève", "ÿþ", "don't", "x" * 900, "A1b2C3", "((()))", "\x00\x01", "ßẞ"[:1], "0" * 77})
    for w in words:
        assert p.fast_a.encode_ordinary(" " + w) == p.a.encode(" " + w, add_special_tokens=False).ids


def test_forgetting_changes_nothing(monkeypatch):
    p = align._pieces(*PATHS)
    texts = [t for _, t in corpus(8, 30)]
    want = [tuple(map(tuple, align._document_pairs(p, *p.numbers([t]), distinct=False))) for t in texts]
    monkeypatch.setattr(align, "REMEMBERED", 3)
    assert [tuple(map(tuple, align._document_pairs(p, *p.numbers([t]), distinct=False))) for t in texts] == want


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 1 << 40, n))
    shards = [keys[shard_of(keys, 3) == s] for s in range(3)]
    parts = [build(k) for k in shards]
    h = PerfectHash([p[0] for p in parts], [p[1] for p in parts], [len(k) for k in shards])
    at = h.places(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))
    if n:
        assert (np.concatenate([p[2] for p in parts])[at] == keys).all()
