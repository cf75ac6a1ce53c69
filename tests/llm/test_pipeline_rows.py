"""Every stage of the pipeline against plain Python, on rows with null and repeated ids, copies and benchmark text."""

from __future__ import annotations

import math
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import xxhash
from test_decontam import brute
from test_mixing import reshare
from test_simhash import groups, plain_fingerprint

from grainline.llm import tokens
from grainline.session import ensure_checkpoint_dir

ITEM = "a needle of exactly ten words that must be found"
TOXIC = "vile scum filthy trash hateful rot"


def fixture():
    r = random.Random(5)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    rows = [(i if i % 4 else None, text(r.randint(20, 60)), r.choice(["a", "b", "c", None])) for i in range(120)]
    rows += [(1000 + i, f"{text(20)} {TOXIC} {text(5)}", "a") for i in range(60)]
    rows += [(None, f"{text(9)} {TOXIC}", "b"), (1, f"{text(9)} {TOXIC}", "b")]  # toxic, beside clean rows of the same id
    rows += [(r.choice([None, 2, 3, 500 + i]), t, s) for i, (_, t, s) in enumerate(r.choices(rows[:120], k=40))]  # copies
    rows += r.choices(rows[:120], k=20)  # repeated rows
    rows += [(None, "only rows without an id", "c")] * 3 + [(5, "the same row again", "a")] * 9
    rows += [(None, f"{text(20)} {ITEM} {text(20)}", "a"), (6, f"{text(20)} {ITEM}", "b"), (6, text(30), "b"), (901, f"{ITEM} {text(25)}", "c")]
    r.shuffle(rows)
    labels = [(1000 + i, 1) for i in range(60)] + [(i, 0) for i in range(7, 120) if i % 4]
    return rows, labels


def one_of_each(rows):
    def order(row):
        h = 42 if row[0] is None else xxhash.xxh64_intdigest(row[0].to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(row[1].encode(), h)
        return row[0] is None, row[0] or 0, h - (h >> 63 << 64)

    comp = groups({k: plain_fingerprint(x[1]) for k, x in enumerate(rows)})
    return [[rows[k] for k in comp if comp[k] == c] for c in sorted(set(comp.values()))], order


def plain(rows):
    return sorted(((r.doc_id, r.text, r.source) for r in rows.collect()), key=str)


def test_every_stage_keeps_the_right_rows(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    rows, labels = fixture()
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    docs = stage["toxicity"](spark, docs, sf).checkpoint()
    clean = [x for x in rows if TOXIC not in x[1]]
    assert plain(docs) == sorted(clean, key=str)

    docs = stage["simhash"](spark, docs, sf).checkpoint()
    members, order = one_of_each(clean)
    got = plain(docs)
    assert len(got) == len(members)
    assert sorted((x[:2] for x in got), key=str) == sorted((min(m, key=order)[:2] for m in members), key=str)
    assert set(got) <= set(clean)  # rows that differ in the source only: one of them

    docs = stage["decontamination"](spark, docs, sf).checkpoint()
    hit = [x for x in got if brute([x[:2]], [(1, ITEM)])[0][-1]]
    assert len(hit) == 3
    got = sorted((x for x in got if x not in hit), key=str)
    assert plain(docs) == got

    docs = stage["mix"](spark, docs, sf).checkpoint()
    sizes: dict = {}
    for _, t, s in got:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, longest = reshare(sizes), max(len(t.split()) for _, t, _ in got)
    mixed = plain(docs)
    assert set(mixed) <= set(got)
    for s, size in sizes.items():
        whole = math.floor(want[s] / size + 1e-9)
        mine = [x for x in mixed if x[2] == s]
        assert abs(sum(len(t.split()) for _, t, _ in mine) - want[s]) <= longest
        assert all(whole <= mine.count(x) <= whole + 1 for x in got if x[2] == s)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    ids = [(d, tok.encode(t, add_special_tokens=False).ids + [0]) for d, t, _ in mixed]
    last = sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in stage["token_ids"](spark, docs, sf).collect()), key=str)
    assert last == sorted(((d, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for d, x in ids), key=str)
