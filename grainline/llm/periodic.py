"""Periodic run detection (operator 12): all maximal runs of repeating words in every text, by string synchronising sets.

A run of period q is a stretch in which words q apart are identical. Runs of at least ``MIN_EXPONENT`` periods are found
scale by scale, tau = 4, 8, 16, ..; scale tau is in charge of the periods from tau to 2 tau - 1:

* Every fragment of tau words has a hash as its name (names of 2 tau words are made from two of tau). A position is
  synchronising if the least name among the fragments that start at it and at the tau positions after it belongs to the
  first or the last of them. That depends on the next 2 tau words alone, so equal contexts of 2 tau words are chosen or
  left out alike, wherever they stand.
* Fragments of a period up to tau / 4 would be chosen everywhere or nowhere; they lie inside runs of smaller periods, which
  are known by then, and have no name. What they leave out is what those runs supply. The periods 1 to 3 are found first,
  by comparing each word with the one so many places on.
* Where the next 3 tau - 1 words are not such a region, one of the next tau positions is synchronising. A run of period q
  in tau .. 2 tau - 1 and of 4 q words therefore holds one in its first tau words, and the one q further on has the same
  context: two synchronising positions of equal context, tau to 2 tau - 1 apart, propose their distance as a period.
* A proposal is extended word by word in both directions and kept if it spans 4 periods. Two such positions overlap, so a
  proposal is always a repetition of more than two periods, unless hashes collide; there are few, and no run is missed.

Texts are rows: nothing is shuffled. Inside a task the texts of similar length of a batch are laid end to end, with a
separator of its own after each, and go through the scales together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, pieces

MIN_EXPONENT = 4
MIN_LENGTH = 6
#: Words that go through the scales together (a longer text goes alone).
WORDS_AT_ONCE = 1_000_000

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_NO_NAME = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _join(names: np.ndarray, width: int) -> np.ndarray:
    """Names of fragments twice as long, from those of ``width`` words."""
    return _mix(names[:-width] * np.uint64(0x9E3779B97F4A7C15) + names[width:])


def _agree(seq: np.ndarray, i: int, q: int, step: int) -> int:
    """How many words from i on, in the direction of ``step``, equal the word q places after them."""
    n, block = 0, 32
    while True:
        if step > 0:
            lo, hi = i + n, min(i + n + block, len(seq) - q)
            same = seq[lo:hi] == seq[lo + q : hi + q]
        else:
            lo, hi = max(i - n - block + 1, 0), i - n + 1
            same = (seq[lo:hi] == seq[lo + q : hi + q])[::-1]
        if not same.all():
            return n + int(same.argmin())
        n += len(same)
        if len(same) < block:
            return n
        block *= 2


def _small_period(seq: np.ndarray, q: int, found: dict[tuple[int, int], int]) -> None:
    edge = np.diff((seq[:-q] == seq[q:]).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= (MIN_EXPONENT - 1) * q
    for s, e in zip(starts[long].tolist(), (ends[long] + q).tolist(), strict=True):
        found.setdefault((s, e), q)


def _proposals(names: np.ndarray, contexts: np.ndarray, tau: int, found: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """(period, position), in this order, of the synchronising positions of equal context tau to 2 tau - 1 apart."""
    held = names.copy()
    for (s, e), q in found.items():
        if MIN_EXPONENT * q <= tau <= e - s:
            held[s : e - tau + 1] = _NO_NAME
    low, width = held, 1
    while width < tau:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    k = len(contexts)
    low = np.minimum(low[:k], held[tau : tau + k])
    at = np.flatnonzero((low != _NO_NAME) & ((held[:k] == low) | (held[tau : tau + k] == low)))
    order = np.argsort(contexts[at], kind="stable")
    context, at = contexts[at][order], at[order]
    out: list[tuple[int, int]] = []
    shift = 1
    while shift < len(at):
        apart = at[shift:] - at[:-shift]
        near = (context[shift:] == context[:-shift]) & (apart < 2 * tau)
        if not near.any():
            break
        pick = np.flatnonzero(near & (apart >= tau))
        out += zip(apart[pick].tolist(), at[pick].tolist(), strict=True)
        shift += 1
    return sorted(out)


def find_runs(seq: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All (start, end, period) of the maximal runs of ``MIN_EXPONENT`` periods or more in ``seq``, int64.

    ``seq`` may be several sequences, none longer than ``longest``, each followed by a value that occurs nowhere else.
    """
    found: dict[tuple[int, int], int] = {}
    for q in (1, 2, 3):
        if MIN_EXPONENT * q <= longest:
            _small_period(seq, q, found)
    tau = 4
    if MIN_EXPONENT * tau <= longest:
        names = _mix(seq.astype(np.uint64) + np.uint64(1))
        names = _join(_join(names, 1), 2)
    while MIN_EXPONENT * tau <= longest:
        contexts = _join(names, tau)
        end, last = -1, 0
        for q, i in _proposals(names, contexts, tau, found):
            if q == last and i + q < end:
                continue  # inside the stretch that was extended last
            last = q
            end = i + q + _agree(seq, i, q, 1)
            start = i + 1 - _agree(seq, i, q, -1)
            if end - start >= MIN_EXPONENT * q:
                found.setdefault((start, end), q)  # one of a smaller period has been found before
        names, tau = contexts, 2 * tau
    return [(s, e, q) for (s, e), q in found.items() if e - s >= MIN_LENGTH]


def _runs_of_texts(texts: list[list[bytes]]) -> dict[int, list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text that has any, in order of start and period."""
    vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
    classes: dict[int, list[int]] = defaultdict(list)
    for i, words in enumerate(texts):
        if len(words) >= MIN_LENGTH:
            classes[len(words).bit_length()].append(i)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for members in classes.values():
        while members:
            some, held = [], 0
            while members and (not some or held + len(texts[members[-1]]) <= WORDS_AT_ONCE):
                some.append(members.pop())
                held += len(texts[some[-1]]) + 1
            starts = np.cumsum([0, *[len(texts[i]) + 1 for i in some]])
            seq = np.empty(starts[-1], dtype=np.int64)
            for k, i in enumerate(some):
                seq[starts[k] : starts[k + 1] - 1] = np.fromiter(map(vocabulary.__getitem__, texts[i]), np.int64, len(texts[i]))
                seq[starts[k + 1] - 1] = -1 - k
            runs = sorted(find_runs(seq, max(len(texts[i]) for i in some)))
            place = np.searchsorted(starts, [r[0] for r in runs], side="right") - 1
            for k, (s, e, q) in zip(place.tolist(), runs, strict=True):
                out[some[k]].append((s - int(starts[k]), e - s, q))
    for runs in out.values():
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches:
        at = 0
        while at < b.num_rows:  # pieces of a bounded number of words
            ids, texts, held = [], [], 0
            while at < b.num_rows and held < WORDS_AT_ONCE:
                text = b.column("text")[at].as_buffer()
                texts.append(text.to_pybytes().split() if text is not None else [])  # bytes.split() cuts at \x20 and \x09-\x0D
                ids.append(at)
                held += len(texts[-1])
                at += 1
            runs = _runs_of_texts(texts)
            none: list[tuple[int, int, int]] = []
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").slice(ids[0], len(ids)),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs.get(i, none)] for i in range(len(texts))], run_type),
                    pa.array([_collapse(t, runs[i]) if i in runs else b" ".join(t) for i, t in enumerate(texts)], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def find_periodic_runs(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, its runs and its words without their repeats, joined by one space.

    ``runs`` holds (start, length, period) of every maximal run of ``MIN_EXPONENT`` periods and ``MIN_LENGTH`` words or more,
    by start, then period; start counts words from 0. The words of a run after its first period are left out of
    ``collapsed``. A null, empty or blank text has no words, no runs and an empty ``collapsed``; a null doc_id stays null;
    repeated rows and ids give a row each; extra columns are ignored; no rows give none. The length of a text is bounded
    only by the memory for some ten integers a word.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCHEMA)


def plant_periods(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic end planted in the texts whose crc32(doc_id) is divisible by 10.

    With h that checksum, g = floor(h / 10) and n words, each word i >= a = g % n becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). Other texts, those without words and those of a null doc_id stay.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, pieces(F.col("text"), SPACE)).alias("words"))
    rows = rows.select("*", F.size("words").alias("n"))
    rows = rows.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))

    def moved(k: Column) -> Column:
        return F.element_at("words", (F.col("a") + k % F.col("p") + 1).cast("int"))

    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), moved))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def run_report(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The digest of the runs of every document with planted periods: one row per row of ``documents``.

    doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest start, then period; null if
    there is none), runs_sha256 over every run's ``start,length,period`` and a line feed, collapsed_sha256.
    """
    found = find_periodic_runs(plant_periods(documents))
    key = F.expr("transform(runs, r -> struct(-r.length as l, r.start as s, r.period as p))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    best = found.select("*", F.array_min(key).alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
