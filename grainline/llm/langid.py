"""Language identification (operator 13): string kernels, Nystroem landmarks and one-versus-rest kernel ridge regression.

A text is the set of its letter n-grams, n = 1 to ``N_GRAM`` (a blended spectrum): its words - runs of letters, in lower
case - with a blank before and after, so that word beginnings and ends are features too. The kernel of two texts is the
number of n-grams that are present in both, over the geometric mean of how many each has.

* Fit: at most ``ROWS_PER_LANGUAGE`` different texts per language, none longer than ``FIT_CHARACTERS``, are drawn by the hash
  of the text, so copies count once and no source, id or order matters. The first of each language are landmarks. Tasks
  compute the kernels of the drawn texts with the landmarks and add up the normal equations; the driver solves one ridge
  regression with a right-hand side per language. What it gets is bounded by these parameters.
* Score: every text, whole. A batch is a 0/1 matrix of texts by landmark n-grams; its product with the landmarks' matrix,
  scaled, is the kernel, and the kernel's product with the coefficients is the score per language.

n-grams are 40-bit hashes. Texts are rows; nothing is shuffled but the bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

N_GRAM = 3
ROWS_PER_LANGUAGE = 2_000
#: Landmarks in all, shared evenly by the languages; each language has at least the second number.
LANDMARKS, LANDMARKS_AT_LEAST = 256, 8
FIT_CHARACTERS = 6_000
RIDGE = 1e-4
#: The remainder of crc32(doc_id) by the modulus that keeps a document out of the fit.
MODULUS, HELD_OUT = 4, 2
UNKNOWN = "und"

#: Words a worker remembers; characters, texts and n-grams of one batch of matrix products.
REMEMBERED = 200_000
CHARACTERS_AT_ONCE = 2 << 20
TEXTS_AT_ONCE = 64
GRAMS_AT_ONCE = 1 << 16

SCORED = "doc_id long, held_out boolean, lang_pred string, score double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams_of(tokens: list[str], n_gram: int = N_GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams of all tokens, end to end, repeats included; where each token's begin).

    A token is a string without white space; what is no letter in it separates words.
    """
    marked = "\n" + "\n".join(tokens) + "\n"
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds, kind = np.unique(code, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], dtype=bool)[kind]
    token = np.cumsum(code == 10) - 1
    value = np.where(letter, code, 0).astype(np.uint64)
    found, of = [], []
    hashed = _mix(value + np.uint64(1))
    inner, some = np.ones(len(code), dtype=bool), letter
    for n in range(1, n_gram + 1):
        if n > 1:
            m = len(code) - n + 1
            hashed = _mix(hashed[:m] * np.uint64(0x9E3779B97F4A7C15) + value[n - 1 :] + np.uint64(1))
            some = some[:m] | letter[n - 1 :]
            if n > 2:
                inner = inner[:m] & letter[n - 2 : n - 2 + m]
        at = np.flatnonzero(inner[: len(some)] & some)
        found.append((hashed[at] >> np.uint64(24)).astype(np.int64))
        of.append(token[at])
    grams, of_token = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of_token, kind="stable")
    return grams[order], np.searchsorted(of_token[order], np.arange(len(tokens) + 1))


class Words:
    """n-grams of words, remembered. What is remembered does not change results."""

    def __init__(self, n_gram: int):
        self.n_gram = n_gram
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.grams, self.first = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(distinct n-grams of every text in order, end to end; where each text's begin)."""
        if len(self.number) > REMEMBERED:
            self.forget()
        tokens = [set(t.lower().split()) for t in texts]
        new = sorted(set().union(*tokens).difference(self.number)) if tokens else []
        if new:
            grams, starts = grams_of(new, self.n_gram)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.first = np.concatenate([self.first[:-1], len(self.grams) + starts])
            self.grams = np.concatenate([self.grams, grams])
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(tokens)), np.int64, sizes.sum())
        n = self.first[word + 1] - self.first[word]
        at = np.arange(n.sum()) + np.repeat(self.first[word] - (np.cumsum(n) - n), n)
        code = (np.repeat(np.repeat(np.arange(len(texts)), sizes), n) << 40) + self.grams[at]
        code.sort()
        code = code[np.flatnonzero(np.diff(code, prepend=-1))]
        return code & ((1 << 40) - 1), np.searchsorted(code >> 40, np.arange(len(texts) + 1))


_WORDS: dict[int, Words] = {}


@dataclass
class Model:
    """Landmarks as sorted n-grams with the landmarks that hold each, the landmarks' sizes, and a column of coefficients
    per language."""

    languages: list[str]
    n_gram: int
    grams: np.ndarray
    holders: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    coefficients: np.ndarray

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(kernel of each text with each landmark, number of distinct n-grams of each text)."""
        words = _WORDS.setdefault(self.n_gram, Words(self.n_gram))
        grams, starts = words.present(texts)
        size = np.diff(starts)
        place = np.searchsorted(self.grams, grams)
        hit = self.grams[np.minimum(place, len(self.grams) - 1)] == grams
        common = np.zeros((len(texts), len(self.sizes)), dtype=np.float32)
        row, column = np.repeat(np.arange(len(texts)), size)[hit], place[hit]
        cuts = np.searchsorted(row, np.arange(0, len(texts) + TEXTS_AT_ONCE, TEXTS_AT_ONCE))
        for lo in range(0, len(self.grams), GRAMS_AT_ONCE):
            block = self._block(lo)
            for k in range(len(cuts) - 1):
                r, c = row[cuts[k] : cuts[k + 1]] - k * TEXTS_AT_ONCE, column[cuts[k] : cuts[k + 1]] - lo
                inside = (c >= 0) & (c < len(block))
                present = np.zeros((min(TEXTS_AT_ONCE, len(texts) - k * TEXTS_AT_ONCE), len(block)), dtype=np.float32)
                present[r[inside], c[inside]] = 1
                common[k * TEXTS_AT_ONCE : (k + 1) * TEXTS_AT_ONCE] += present @ block
        return common / np.sqrt(np.maximum(size, 1)[:, None] * self.sizes[None, :]), size

    def _block(self, lo: int) -> np.ndarray:
        """0/1: which landmark holds which of ``GRAMS_AT_ONCE`` n-grams. Kept where there is one block."""
        held = self.__dict__.get("_held")
        if held is not None:
            return held
        hi = min(lo + GRAMS_AT_ONCE, len(self.grams))
        block = np.zeros((hi - lo, len(self.sizes)), dtype=np.float32)
        row = np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1]))
        block[row, self.holders[self.first[lo] : self.first[hi]]] = 1
        if len(self.grams) <= GRAMS_AT_ONCE:
            self.__dict__["_held"] = block
        return block

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score 0 to 1) of each text; ties go to the first language by code point; without a letter unknown."""
        kernel, size = self.kernel(texts)
        value = kernel @ self.coefficients
        best = value.argmax(axis=1)
        score = np.clip((value[np.arange(len(texts)), best] + 1) / 2, 0, 1)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), size.tolist(), strict=True)], np.where(size > 0, score, 0.0)


def landmark_model(texts: list[str], languages: list[str], n_gram: int = N_GRAM) -> Model:
    """A model with these landmarks and no coefficients yet."""
    grams, starts = Words(n_gram).present(texts)
    order = np.argsort(grams, kind="stable")
    distinct, first = np.unique(grams[order], return_index=True)
    holder = np.repeat(np.arange(len(texts)), np.diff(starts))[order]
    sizes = np.diff(starts).astype(np.float64)
    return Model(languages, n_gram, distinct, holder.astype(np.int32), np.append(first, len(grams)), sizes, np.zeros((len(texts), len(languages))))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of a bounded number of characters (a longer text comes alone); a null text is empty."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            start, texts, held = at, [], 0
            while at < b.num_rows and held < CHARACTERS_AT_ONCE:
                texts.append(b.column("text")[at].as_py() or "")
                held += len(texts[-1])
                at += 1
            yield b.slice(start, len(texts)), texts


def _normal_equations(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    m, place = len(model.sizes), {lang: i for i, lang in enumerate(model.languages)}
    gram, right = np.zeros((m, m)), np.zeros((m, len(place)))
    for b, texts in _texts(batches):
        kernel, _ = model.kernel(texts)
        target = np.full((len(texts), len(place)), -1.0)
        target[np.arange(len(texts)), [place[x] for x in b.column("lang").to_pylist()]] = 1
        gram += kernel.T @ kernel
        right += kernel.T @ target
    yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], ["gram", "right_side"])


def learnable(documents: DataFrame) -> DataFrame:
    """(lang, text, h) of the documents a model may learn from: a language, a letter, and not held out; h hashes the text."""
    rows = documents.select(F.col("doc_id").cast("long").cast("string").alias("id"), "lang", "text")
    rows = rows.where(F.col("lang").isNotNull() & (F.crc32("id") % MODULUS != HELD_OUT) & (F.char_length("text") <= FIT_CHARACTERS) & F.col("text").rlike(r"\p{L}"))
    return rows.select("lang", "text", F.xxhash64("text").alias("h"))


def train(spark: SparkSession, documents: DataFrame, n_gram: int = N_GRAM) -> Model | None:
    """Fit on a bounded sample of ``documents`` (doc_id, lang, text); None if no row can be learnt from.

    Rows without an id, a language or a letter, held-out rows and texts above ``FIT_CHARACTERS`` are not learnt from. The same
    text twice in a language counts once; in two languages it counts in both.
    """
    scratch = Scratch(spark, "langid")
    rows = learnable(documents)
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy("lang").collect()  # one row a language
    if not found:
        return None
    rate = F.create_map(*chain.from_iterable((F.lit(r.lang), F.lit(1.2 * ROWS_PER_LANGUAGE / max(r.n, 1))) for r in found))
    drawn = rows.where(F.pmod("h", F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.element_at(rate, F.col("lang"))).dropDuplicates(["lang", "h"])
    drawn = drawn.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))).where(F.col("rank") <= ROWS_PER_LANGUAGE)
    drawn = scratch.keep(drawn, "drawn")
    languages = [r.lang for r in found]
    each = max(LANDMARKS_AT_LEAST, LANDMARKS // len(languages))
    marks = drawn.where(F.col("rank") <= each).select("lang", "rank", "text").orderBy("lang", "rank").collect()  # bounded in rows and characters
    model = landmark_model([r.text for r in marks], languages, n_gram)
    m, c = len(marks), len(languages)
    gram, right, n = np.zeros((m, m)), np.zeros((m, c)), drawn.count()
    for r in drawn.select("lang", "text").mapInArrow(lambda it: _normal_equations(it, model), "gram binary, right_side binary").toLocalIterator():
        gram += np.frombuffer(r.gram).reshape(m, m)
        right += np.frombuffer(r.right_side).reshape(m, c)
    among = model.kernel([r.text for r in marks])[0].astype(np.float64)
    system = gram + RIDGE * n * (among + among.T) / 2 + 1e-9 * n * np.eye(m)  # the last term: equal landmarks
    model.coefficients = np.linalg.solve(system, right)
    scratch.close()
    return model


def identify(spark: SparkSession, documents: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, lang_pred, score, from the whole text alone.

    ``held_out``: crc32 of the id as text leaves ``HELD_OUT`` by ``MODULUS`` (a null id does not). ``lang_pred`` is a language of
    the model, or ``und`` with score 0 if the text is null, has no letter, or there is no model. ``score`` is the regression's
    value, which aims at 1 for a language and -1 for the others, moved to 0 .. 1. Equal texts get equal rows; extra columns are
    ignored; no rows give none.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % MODULUS == HELD_OUT, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _texts(batches):
            language, score = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(language, pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, SCORED)
