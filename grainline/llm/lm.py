"""LM scoring (operator 7): prediction by partial matching over byte contexts, pretrained on the corpus.

A text is scored as its words, A-Z in lower case, joined by single spaces, and an end mark. The trie of contexts of up to
``ORDER`` bytes is kept as its leaves, byte grams of ``ORDER + 1`` with their counts; the inner nodes are sums over them.
A symbol is predicted in the longest context that has been seen; an unseen symbol costs the escape, estimated as the
number of distinct symbols over that number plus all counts (method C), and goes on in the next shorter context, where
the symbols of the longer one are excluded; below order 0 the remaining bytes are equally likely. All symbols of a context
so have probabilities that add up to 1.

Nothing of the model is broadcast but its orders 0 and 1, at most 256 x 256 counts. Documents are packed where they are
read into blocks of about ``BLOCK_BYTES`` at most, one compressed row each; a block names its distinct grams and words
once, with their counts in its training documents. These rows are summed per key (map-side combined), the log probability
of every distinct gram is worked out among the grams that share its last two context bytes, and each block gets back the
values of its own keys, as a dictionary whose size is bounded by the block's: a task of that join sends a block one
compressed row for all keys it has of it, so that no key is sorted by block. Words are keyed by 62 bits of a hash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

ORDER = 5
BLOCK_BYTES = 32 << 20
SCALE = float(1 << 32)  # log probabilities travel as whole multiples of its inverse, which shuffle small
STEP = 1 << 19  # positions whose grams are counted at once
GATHERED = 1 << 19  # values that a task of the join collects before it sends them to their blocks
SCORED = 1 << 18  # positions scored at once; sums of whole multiples of 1 / SCALE do not depend on it
START, END = 0xFE, 0xFF  # bytes that UTF-8 does not have
_CLEAN = bytes.maketrans(b"\xfe\xff", b"??")
BLOCKS = "block long, ids array<long>, held array<boolean>, sizes array<long>, texts binary"
DICTIONARY = "block long, key long, n long"
VALUES = "block long, n long, keys binary, values binary"
WORD = 1 << 62  # keys of words have this bit, those of grams are smaller


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves out: crc32 of the id as text leaves 2 when divided by 7; a null id is never one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's documents: their texts as words joined by spaces, end to end and compressed."""
    part, made = TaskContext.get().partitionId(), 0
    ids, held, texts, size = [], [], [], 0

    def row() -> pa.RecordBatch:
        nonlocal made
        made += 1
        sizes = pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))
        blob = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
        cols = [pa.array([(part << 32) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), sizes, pa.array([blob], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["block", "ids", "held", "sizes", "texts"])

    for b in batches:
        for d, h, t in zip(b.column("doc_id"), b.column("held_out"), b.column("text").cast(pa.binary()), strict=True):
            ids.append(d.as_py())
            held.append(h.as_py())
            texts.append(b" ".join(words_of(t.as_py())))
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield row()
                ids, held, texts, size = [], [], [], 0
    if ids:
        yield row()


def unpack(sizes: list[int], blob: pa.Buffer) -> Iterator[bytes]:
    """The texts of a block one by one; they are never there all at once."""
    with pa.CompressedInputStream(pa.BufferReader(blob), "zstd") as texts:
        for n in sizes:
            text = texts.read(n) if n else b""
            if len(text) != n:
                raise ValueError(f"a text of a block has {len(text)} of {n} bytes")
            yield text


def word_key(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) >> 2 | WORD


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a packed text and its end, which is the empty word."""
    return [*text.split(b" "), b""] if text else [b""]


def _runs(texts: Iterable[tuple[int, bytes]], order: int, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, owner) of about ``step`` positions at a time, of numbered texts."""
    pad, buf, owners, size = bytes([START]) * order, [], [], 0

    def grams() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        b = np.frombuffer(b"".join(buf), dtype=np.uint8)
        own = np.repeat(np.array(owners, dtype=np.int32), [len(x) for x in buf])
        for at in range(0, len(b) - order, step):
            part = b[at : at + step + order]
            g = np.zeros(len(part) - order, dtype=np.uint64)
            for i in range(order + 1):
                g |= part[order - i : len(part) - i].astype(np.uint64) << np.uint64(8 * i)
            real = part[order:] != START
            yield g[real], own[at + order : at + order + len(g)][real]

    for k, t in texts:
        buf.append(pad + t.translate(_CLEAN) + bytes([END]))
        owners.append(k)
        size += len(buf[-1])
        if size >= step:
            yield from grams()
            buf, owners, size = [], [], 0
    if buf:
        yield from grams()


def _merge(u: np.ndarray, n: np.ndarray, g: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Add the grams ``g`` to the sorted distinct ``u`` with counts ``n``."""
    v, m = np.unique(g, return_counts=True)
    at = np.searchsorted(u, v)
    known = np.zeros(len(v), dtype=bool)
    inside = at < len(u)
    known[inside] = u[at[inside]] == v[inside]
    n = n.copy()
    n[at[known]] += m[known] * weight
    return np.insert(u, at[~known], v[~known]), np.insert(n, at[~known], m[~known] * weight)


def _dictionary(held: list[bool], sizes: list[int], blob: pa.Buffer, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a block's distinct grams and words, and their counts in its training rows."""
    count: Counter[bytes] = Counter({b"": 0})
    u, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for out in (False, True):

        def mine(out=out):
            for k, t in enumerate(unpack(sizes, blob)):
                if held[k] == out:
                    if out:
                        for w in tokens_of(t):
                            count.setdefault(w, 0)
                    else:
                        count.update(tokens_of(t))
                    yield k, t

        for g, _ in _runs(mine(), order):
            u, n = _merge(u, n, g, 0 if out else 1)
    words = np.fromiter(map(word_key, count), dtype=np.int64, count=len(count))
    return np.concatenate([u.view(np.int64), words]), np.concatenate([n, np.fromiter(count.values(), dtype=np.int64, count=len(count))])


def dictionaries(batches: Iterator[pa.RecordBatch], order: int = ORDER) -> Iterator[pa.RecordBatch]:
    """The distinct grams and words of each block with their counts in its training rows."""
    for b in batches:
        for i in range(b.num_rows):
            block, held, sizes = (b.column(c)[i].as_py() for c in ("block", "held", "sizes"))
            keys, counts = _dictionary(held, sizes, b.column("texts")[i].as_buffer(), order)
            for at in range(0, len(keys), 1 << 18):
                k, c = keys[at : at + (1 << 18)], counts[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k), pa.array(c)], ["block", "key", "n"])
            del keys, counts, k, c


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of about ``GATHERED`` rows (block, key, value) at a time: its keys and values, compressed."""
    held: list[list[np.ndarray]] = []

    def rows() -> pa.RecordBatch:
        block, key, value = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(block, kind="stable")
        block, key, value = block[order], key[order], value[order]
        first = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        last = np.append(first[1:], len(block))
        packed = ([pa.compress(x[i:j].tobytes(), codec="zstd", asbytes=True) for i, j in zip(first, last, strict=True)] for x in (key, value))
        return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(last - first), *(pa.array(x, pa.binary()) for x in packed)], ["block", "n", "keys", "values"])

    size = 0
    for b in batches:
        if b.num_rows:
            held.append([b.column(c).to_numpy().copy() for c in ("block", "key", "value")])
            size += b.num_rows
        if size >= GATHERED:
            yield rows()
            size = 0
    if size:
        yield rows()


def gathered(values: pa.Table, column: str) -> np.ndarray:
    """One column of the rows that ``gather`` made for a block, end to end."""
    out, at = np.zeros(sum(values.column("n").to_pylist()), dtype=np.int64), 0
    for n, x in zip(values.column("n").to_pylist(), values.column(column), strict=True):
        out[at : at + n] = np.frombuffer(pa.decompress(x.as_buffer(), decompressed_size=8 * n, codec="zstd"), dtype=np.int64)
        at += n
    return out


def _group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


def log_probabilities(gram: np.ndarray, n: np.ndarray, low: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 P of every gram's last byte after its context.

    ``gram`` and ``n`` must hold all grams that share the last two context bytes of any of them; ``low`` are the counts by
    last context byte and symbol, 256 x 256, over the whole corpus.
    """
    gram = gram.astype(np.uint64)
    trained, counts = gram[n > 0], n[n > 0].astype(np.float64)
    eight = np.uint64(8)
    low = low.astype(np.float64)
    zero = low.sum(axis=0)
    tables = {}  # by order: nodes, their counts, contexts, C, D, and what the parent context counts for the same symbols
    for o in range(order, 1, -1):
        mask = np.uint64((1 << (8 * (o + 1))) - 1)
        nodes, at = _group(trained & mask)
        of = np.bincount(at, weights=counts, minlength=len(nodes))
        ctx, owner = _group(nodes >> eight)
        tables[o] = [nodes, of, ctx, np.bincount(owner, weights=of), np.bincount(owner), owner, None]
    for o, t in tables.items():
        nodes = t[0]
        if o > 2:
            parent = tables[o - 1]
            above = parent[1][np.searchsorted(parent[0], nodes & np.uint64((1 << (8 * o)) - 1))]
        else:
            above = low[(nodes >> eight) & np.uint64(255), nodes & np.uint64(255)]
        t[6] = np.bincount(t[5], weights=above, minlength=len(t[2]))

    out, open_ = np.zeros(len(gram)), np.ones(len(gram), dtype=bool)
    gone, gone_d = np.zeros(len(gram)), np.zeros(len(gram))  # counts and number of the excluded symbols
    sym, last = (gram & np.uint64(255)).astype(np.int64), ((gram >> eight) & np.uint64(255)).astype(np.int64)
    for o in range(order, -1, -1):
        if o > 1:
            nodes, of, ctx, c_all, d_all, _, above = tables[o]
            q = gram & np.uint64((1 << (8 * (o + 1))) - 1)
            if len(ctx):
                j = np.minimum(np.searchsorted(ctx, q >> eight), len(ctx) - 1)
                seen = ctx[j] == q >> eight
                i = np.minimum(np.searchsorted(nodes, q), len(nodes) - 1)
                mine = np.where(nodes[i] == q, of[i], 0.0)
                c, d, up = np.where(seen, c_all[j], 0.0), np.where(seen, d_all[j], 0), np.where(seen, above[j], 0.0)
            else:
                mine = c = d = up = np.zeros(len(gram))
        elif o == 1:
            mine, c, d = low[last, sym], low.sum(axis=1)[last], (low > 0).sum(axis=1)[last]
            up = ((low > 0) @ zero)[last]
        else:
            mine, c, d, up = zero[sym], np.full(len(gram), zero.sum()), np.full(len(gram), (zero > 0).sum()), 0.0
        rest, rest_d = c - gone, d - gone_d
        total = rest + rest_d
        hit = open_ & (mine > 0)
        out[hit] += np.log10(mine[hit] / total[hit])
        miss = open_ & ~hit & (rest_d > 0)
        out[miss] += np.log10(rest_d[miss] / total[miss])
        open_ &= ~hit
        gone, gone_d = up, d
    out[open_] -= np.log10(256 - gone_d[open_])
    return out


class Lookup:
    """Values of known 64-bit keys, by a hash table in one array; keys that share a slot are searched for."""

    BITS = 22

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.slots = np.zeros(1 << self.BITS, dtype=np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(g)]
        bad = np.flatnonzero(self.keys[at] != g)
        if len(bad):
            at[bad] = np.searchsorted(self.keys, g[bad])
        return self.values[at]


def score_block(t: pa.Table, values: pa.Table, log_all: float, order: int = ORDER) -> pa.Table:
    """Scores of a block's documents from the gathered values of its grams (scaled log probabilities) and words (counts);
    ``log_all`` is the logarithm of the base model's denominator."""
    ids, held, sizes = (t.column(c)[0].as_py() for c in ("ids", "held", "sizes"))
    blob = t.column("texts")[0].as_buffer()
    keys, logs = gathered(values, "keys"), gathered(values, "values").astype(np.float64)
    word = keys >= WORD
    logs[word] = np.log10(logs[word] + 1.0) - log_all
    logs[~word] /= -SCALE
    value = Lookup(keys.view(np.uint64), logs)
    del keys, values, logs, word
    k = len(ids)
    of_word: dict[bytes, float] = {}
    n_tokens, n_known, base, score = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k), np.zeros(k)

    def numbered() -> Iterator[tuple[int, bytes]]:
        for i, text in enumerate(unpack(sizes, blob)):
            tokens = tokens_of(text)
            new = [w for w in dict.fromkeys(tokens) if w not in of_word]
            if new:
                of_word.update(zip(new, value(np.fromiter(map(word_key, new), dtype=np.uint64, count=len(new))).tolist(), strict=True))
            logs = np.fromiter(map(of_word.__getitem__, tokens), dtype=np.float64, count=len(tokens))
            n_tokens[i], base[i] = len(logs), logs.sum()
            n_known[i] = (logs > 0.15 - log_all).sum()  # an unknown word has log10(1), a known one log10(2) at least
            yield i, text

    for g, own in _runs(numbered(), order, SCORED):
        score += np.bincount(own, weights=value(g), minlength=k)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held), "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": score})


def score_documents(spark: SparkSession, documents: DataFrame, held: Column | None = None, order: int = ORDER) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``held`` says which rows training leaves out (default: ``held_out`` of the id). A null, empty or wordless text is the
    end mark alone. Repeated rows count, and score, each time. Where every row is held out the model knows nothing: all
    bytes are equally likely and the base score is 0. Extra columns are ignored; no documents: no rows.
    """
    scratch = Scratch(spark, "lm")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (held_out(F.col("doc_id")) if held is None else held).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    blocks = scratch.keep(rows.mapInArrow(pack, BLOCKS), "blocks")
    names = scratch.keep(blocks.mapInArrow(lambda it: dictionaries(it, order), DICTIONARY), "dictionary")
    summed = scratch.keep(names.groupBy("key").agg(F.sum("n").alias("n")), "sums")
    word = F.col("key") >= WORD
    n_train, n_types = summed.where(word).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    log_all = math.log10(n_train + 1 * (n_types + 1))
    of_word = summed.where(word).select("key", F.col("n").alias("value"))

    of_gram = summed.where(~word)
    low = np.zeros((256, 256), dtype=np.int64)
    pair = F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("pair")
    for r in of_gram.groupBy(pair).agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        low[r["pair"] >> 8, r["pair"] & 255] = r["n"]

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            t = pa.Table.from_batches(batches)
            g = t.column("key").to_numpy()
            p = np.rint(log_probabilities(g, t.column("n").to_numpy(), low, order) * -SCALE).astype(np.int64)
            for i in range(0, len(g), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(g[i : i + (1 << 18)]), pa.array(p[i : i + (1 << 18)])], ["key", "value"])

    by_context = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    values = scratch.keep(of_gram.repartition(by_context).mapInArrow(model, "key long, value long").unionAll(of_word), "values")
    scratch.drop(summed)
    back = names.select("block", "key").join(values, "key").select("block", "key", "value").mapInArrow(gather, VALUES)
    scored = (
        blocks.groupBy("block")
        .cogroup(back.groupBy("block"))
        .applyInArrow(lambda t, v: score_block(t, v, log_all, order), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
