from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from helpers import CLASH, documents
from pyspark.sql import functions as F
from scales import SF_MID

from grainline.llm import langid

ODD = ["", " \n", "123 $%", "½ ² Ⅷ _", "a", "É", "x1y2 z", "Don't stop-me NOW now", "日本語 テスト", "İstanbul ﬁ", "a " * 500, "word" * 3000]


def plain_grams(text: str, n_gram: int = langid.N_GRAM) -> set[str]:
    """The n-grams of a text as strings, word by word."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = set()
    for w in words:
        w = f" {w} "
        out |= {w[i : i + n] for n in range(1, n_gram + 1) for i in range(len(w) - n + 1)} - {" "}
    return out


def syllables(seed: int, n: int, languages=("xa", "xb", "xc")):
    """Texts of invented languages that differ in their syllables."""
    r = random.Random(seed)
    stock = {lang: ["".join(r.choices("bcdfglmnprst", k=1) + r.choices("aeiou", k=1) + r.choices("lnrs ", k=1)).strip() for _ in range(25)] for lang in languages}
    out = []
    for i in range(n):
        lang = r.choice(languages)
        out.append((i, " ".join("".join(r.choices(stock[lang], k=r.randint(1, 3))) for _ in range(r.randint(3, 60))), lang))
    return out


def frame(spark, rows):
    full = [(d, t, lang, "s", 0, "k", 7, 7, "w", 7, 7, 7, "c", 7, 7) for d, t, lang in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.mark.parametrize("n_gram", [1, 2, 3, 4])
def test_grams_are_the_words_substrings(n_gram):
    texts = ODD + [t for _, t, _ in syllables(1, 20)]
    grams, starts = langid.Words(n_gram).present(texts)
    sets = [plain_grams(t, n_gram) for t in texts]
    assert np.diff(starts).tolist() == [len(s) for s in sets]
    for i in range(len(texts)):
        for j in range(len(texts)):
            common = np.intersect1d(grams[starts[i] : starts[i + 1]], grams[starts[j] : starts[j + 1]])
            assert len(common) == len(sets[i] & sets[j])


def test_kernel_and_scores_are_the_formula(monkeypatch):
    marks = [t for _, t, _ in syllables(2, 9)]
    model = langid.landmark_model(marks, ["a", "b"])
    model.coefficients = np.random.default_rng(1).normal(size=(9, 2)) * 0.1
    texts = ODD + [t for _, t, _ in syllables(3, 150)]
    sets, held = [plain_grams(t) for t in texts], [plain_grams(t) for t in marks]
    want = np.array([[len(s & h) / np.sqrt(max(len(s), 1) * len(h)) for h in held] for s in sets])
    value = want @ model.coefficients
    for block in (1 << 16, 50):  # one block of n-grams and many
        monkeypatch.setattr(langid, "GRAMS_AT_ONCE", block)
        model.__dict__.pop("_held", None)
        assert np.allclose(model.kernel(texts)[0], want, atol=1e-5)
        language, score = model.predict(texts)
        assert language == [model.languages[i] if s else "und" for i, s in zip(value.argmax(axis=1).tolist(), sets, strict=True)]
        assert np.allclose(score, [min(max((v.max() + 1) / 2, 0), 1) if s else 0 for v, s in zip(value, sets, strict=True)], atol=1e-5)


def test_fit_is_ridge_regression(spark):
    """The summed normal equations give what one matrix of all rows gives."""
    docs = syllables(4, 200)
    model = langid.train(spark, frame(spark, docs).repartition(5))
    rows = sorted({(lang, t) for d, t, lang in docs if zlib.crc32(str(d).encode()) % 4 != 2})
    k = model.kernel([t for _, t in rows])[0].astype(np.float64)
    y = np.array([[1.0 if lang == x else -1.0 for x in model.languages] for lang, _ in rows])
    fitted = k @ model.coefficients
    assert model.languages == ["xa", "xb", "xc"]
    # as many landmarks as rows: ridge regression in the kernel itself, so the fit is close and no constant
    assert (fitted.argmax(axis=1) == y.argmax(axis=1)).mean() > 0.98
    assert np.abs(fitted - y).mean() < 0.2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = langid.identify(spark, docs, langid.train(spark, docs))
    assert got.count() == docs.count()
    right = got.join(docs.select("doc_id", "lang"), "doc_id").groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).collect()
    assert len(right) == 2 and min(r[1] for r in right) > 0.98
    held = {r.doc_id: r.held_out for r in got.collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h in held.items())


def test_only_text_and_training_labels_matter(spark):
    docs = syllables(6, 120)
    base = langid.train(spark, frame(spark, docs))
    out = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(spark, frame(spark, docs), base).collect()}
    wrong = [(d, t, lang if zlib.crc32(str(d).encode()) % 4 != 2 else "zz") for d, t, lang in docs]  # held-out labels spoilt
    model = langid.train(spark, frame(spark, wrong).withColumn("source", F.lit("t")).repartition(3))
    again = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(spark, frame(spark, wrong), model).collect()}
    assert {d: x for d, (x, _) in out.items()} == {d: x for d, (x, _) in again.items()}
    assert np.allclose([out[d][1] for d in out], [again[d][1] for d in out], atol=1e-4)


def test_edge_cases(spark):
    docs = syllables(7, 60)
    odd = [(None, docs[0][1], "xa"), (1000, None, "xa"), (1001, "", None), (1002, "12 !", "xb"), (1003, docs[1][1] + " " + docs[1][1], None), (1003, docs[1][1], None), (1004, (docs[2][1] + " ") * 3000, None)]
    model = langid.train(spark, frame(spark, docs + odd))
    got = [tuple(r) for r in langid.identify(spark, frame(spark, docs + odd), model).collect()]
    assert len(got) == len(docs) + len(odd)
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r[1:])
    assert by_id[None][0][0] is False and by_id[None][0][1] == by_id[0][0][1]
    assert all(by_id[d][0][1:] == ("und", 0.0) for d in (1000, 1001, 1002))
    assert len(set(by_id[1003])) == 1  # presence: a repeated text is the same set
    assert by_id[1004][0][1] == by_id[2][0][1]
    assert all(0 <= x[2] <= 1 for rows in by_id.values() for x in rows)


def test_nothing_to_learn(spark):
    assert langid.train(spark, documents(spark, [])) is None
    assert langid.identify(spark, documents(spark, []), None).collect() == []
    rows = frame(spark, [(1, "some text", None), (2, None, "xa")])
    assert langid.train(spark, rows) is None
    assert [tuple(r)[2:] for r in langid.identify(spark, rows, None).collect()] == [("und", 0.0)] * 2
    alone = frame(spark, [(1, "some text", "xa"), (4, "text", "xa")])
    assert {r.lang_pred for r in langid.identify(spark, alone, langid.train(spark, alone)).collect()} == {"xa"}
