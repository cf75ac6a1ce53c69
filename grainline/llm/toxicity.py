"""Toxicity (operator 10): cumulative-link ordinal regression over sparse text features.

``P(grade >= k) = sigmoid(w . x - theta_k)``: one weight vector for all grades, one rising threshold per grade; the
expected severity is the sum of these probabilities. Features are the presence of hashed words and of hashed word
beginnings, of those only the ones whose share differs significantly between toxic and other rows. The model is fitted on a bounded, hash-ordered sample of the labelled rows (``MAX_ROWS``); scoring covers
every document. The table has only 0/1 labels, so toxic rows are graded from the data: a toxic row is severe (2) if it
holds more distinct marker features (far more frequent in toxic rows) than the median toxic row, else mild (1).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 18
MAX_ROWS = 12_000
MIN_ROWS_OF_FEATURE = 3
MIN_Z = 4.0  # standard errors by which a feature's share must differ between toxic and other rows
MARKER_ODDS = 20.0
EPOCHS, RATE, L2 = 600, 0.5, 2e-5
REJECT_AT = 0.5
PREFIXES = (4, 5)
EDGE = ".,;:!?\"'()[]"


def features(text: str | None) -> np.ndarray:
    """The sorted distinct feature numbers of a text: its lower-cased words without edge punctuation, and their beginnings."""
    crc, mask, out = zlib.crc32, (1 << BITS) - 1, set()
    for w in set((text or "").lower().split()):
        w = w.strip(EDGE)
        if w:
            out.add(crc(w.encode("utf-8", "surrogatepass")) & mask)
            for n in PREFIXES:
                if len(w) > n:
                    out.add(crc(f"{w[:n]}*".encode("utf-8", "surrogatepass")) & mask)
    return np.array(sorted(out), dtype=np.int32)


@dataclass
class Model:
    """Weights by feature and one threshold per grade above 0; without thresholds every text has severity 0."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return _sigmoid(float(self.weights[x].sum(dtype=np.float64)) - self.thresholds)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All rows' features one after the other, and whose they are."""
    ids = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    return ids, np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])


def grade(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 of labelled rows (see the module text)."""
    y = np.asarray(toxic, dtype=np.int64).clip(0, 1)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1:
        return y
    ids, owner = _flat(rows)
    in1 = np.bincount(ids[y[owner] == 1], minlength=1 << BITS)
    in0 = np.bincount(ids[y[owner] == 0], minlength=1 << BITS)
    marker = (in1 >= MIN_ROWS_OF_FEATURE) & (in1 / n1 > MARKER_ODDS * (in0 + 0.5) / max(n0, 1))
    marks = np.bincount(owner, weights=marker[ids], minlength=len(rows))
    return y + (y & (marks > np.median(marks[y == 1])))


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Full-batch AdaGrad on the cumulative-link likelihood; deterministic."""
    top = int(y.max()) if len(y) else 0
    w = np.zeros(1 << BITS)
    if not top or not (y == 0).any():
        return Model(w.astype(np.float32), np.array([]))
    ids, owner = _flat(rows)
    every = y[owner] > 0
    in1, in0 = (np.bincount(ids[every == k], minlength=1 << BITS) for k in (True, False))
    n1, n0 = int((y > 0).sum()), int((y == 0).sum())
    both = (in1 + in0) / (n1 + n0)
    z = np.abs(in1 / n1 - in0 / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n1 + 1 / n0))
    keep = ((in1 + in0 >= MIN_ROWS_OF_FEATURE) & (z >= MIN_Z))[ids]
    owner = owner[keep]
    used, ids = np.unique(ids[keep], return_inverse=True)
    v = np.zeros(len(used))
    share = np.array([(y >= k).mean() for k in range(1, top + 1)])
    theta = np.log((1 - share) / share)
    sum_v, sum_t = np.full(len(used), 1e-8), np.full(top, 1e-8)
    n = len(rows)
    for _ in range(EPOCHS):
        s = np.bincount(owner, weights=v[ids], minlength=n)
        c = np.hstack([np.ones((n, 1)), _sigmoid(s[:, None] - theta), np.zeros((n, 1))])  # P(y >= k), k = 0 .. top + 1
        d = c * (1 - c)
        at = np.arange(n)
        p = np.maximum(c[at, y] - c[at, y + 1], 1e-12)
        g_s = -(d[at, y] - d[at, y + 1]) / p
        g_v = np.bincount(ids, weights=g_s[owner], minlength=len(used)) / n + L2 * v
        g_t = np.array([((y == k) * d[:, k] / p - (y == k - 1) * d[:, k] / p).sum() for k in range(1, top + 1)]) / n
        sum_v += g_v**2
        sum_t += g_t**2
        v -= RATE * g_v / np.sqrt(sum_v)
        theta = np.sort(theta - RATE * g_t / np.sqrt(sum_t))
    w[used] = v
    return Model(w.astype(np.float32), theta)


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most about ``max_rows`` labelled documents, chosen by a hash of the id; null labels and ids are left out."""
    labelled = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = labelled.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, max_rows / max(n, 1)) * (1 << 30))
    chosen = labelled.where(part).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # about max_rows rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(x, pa.binary())], ["doc_id", "toxic", "x"])

    rows = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")), "doc_id")
        .mapInArrow(run, "doc_id long, toxic int, x binary")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("x", "ascending")])
    )
    xs = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in rows.column("x")]
    return fit(xs, grade(xs, rows.column("toxic").to_numpy()))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, severity (expected grade), p_mild and p_severe (chance of grade 1 or 2, or more), grade, rejected.

    A null or empty text has no features, and so the score of the intercepts, which keep it (``rejected`` false). Repeated
    rows score alike; extra columns are ignored; no documents: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.zeros((b.num_rows, 2))
            sev = np.zeros(b.num_rows)
            grades = np.zeros(b.num_rows, dtype=np.int32)
            for i, t in enumerate(b.column("text")):
                c = model.score(features(t.as_py()))
                p[i, : len(c)] = c[:2]
                sev[i], grades[i] = c.sum(), int((c >= REJECT_AT).sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sev), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), pa.array(grades), pa.array(p[:, 0] >= REJECT_AT)],
                ["doc_id", "severity", "p_mild", "p_severe", "grade", "rejected"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, severity double, p_mild double, p_severe double, grade int, rejected boolean"
    )


def drop_toxic(spark: SparkSession, documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` without the rows the model rejects, in one pass: the text is judged where it stands."""

    @F.pandas_udf("boolean")
    def rejected(text):
        return text.map(lambda t: bool((model.score(features(t))[:1] >= REJECT_AT).any()))

    return documents.where(~rejected(F.coalesce("text", F.lit(""))))
