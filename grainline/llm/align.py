"""Cross-tokenizer alignment (operator 11): how the ids of two tokenizers cover the same text, and how common each pair is.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece BPE with byte fallback. Both encode a space
and the text. Byte offsets at which tokens of A and of B end together cut the tokens into groups; two tokens whose bytes
overlap are linked; the count of an id pair is the number of documents that hold it linked.

Counting takes two passes over the documents, with a minimal perfect hash (``perfect_hash``) of the distinct pairs between:

1. Each task aligns its documents and writes the pairs it met with the number of its documents that hold them. The
   distinct pairs are dealt into shards of about ``SHARD_PAIRS`` by their hash, and each shard gets its hash function. What
   the tasks counted is added up to dense vectors indexed by that hash: one vector for a few tasks' rows, then
   ``FAN_IN`` vectors into one, round by round.
2. The documents are aligned again, and each pair's count is looked up by its hash, its key verified.

While functions, keys and counts together measure less than ``BROADCAST_BYTES``, every task gets them whole. Beyond that a
document's pairs are dealt by shard, salted, and each shard's part of the index meets them there. Only a vector with one
entry per id of A - its highest count - goes everywhere in any case: the vocabulary bounds it.

Neither tokenizer joins bytes over a place where a space follows something that is no white space, so texts are cut there
and every distinct piece is aligned once per worker while it is remembered. What is remembered does not change results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .perfect_hash import PerfectHash, build, shard_of
from .tokens import byte_of_character

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
SHARD_PAIRS = 1 << 16
FAN_IN = 16
#: Task rows (pairs) that one dense vector takes up at the first level.
ROWS_A_VECTOR = 1 << 20
BROADCAST_BYTES = 64 << 20
#: Rows of one shard that meet one copy of its part of the index.
ROWS_A_SALT = 20_000
#: Pieces a worker remembers; pairs it counts before it writes them; characters it aligns at once.
REMEMBERED = 500_000
PAIRS_HELD = 1 << 20
CHARACTERS_AT_ONCE = 4 << 20

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
INDEX = "shard int, sizes array<int>, bits binary, keys binary, counts binary"


def _ranks(path: str, bytes_of: list[bytes]) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if the file is a plain byte-level BPE whose merges come in the order of their ids.

    Then the merge of the lowest rank is the merge of the lowest id, and the tiktoken library finds the same ids faster.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    ids = [model["vocab"][m] for m in merged]
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not plain or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges") or ids != sorted(set(ids)) or len(ids) + 256 != len(model["vocab"].keys() - {t["content"] for t in spec["added_tokens"]}):
        return None
    return {bytes_of[i]: i for t, i in model["vocab"].items() if t not in {x["content"] for x in spec["added_tokens"]}}


#: How byte-level BPE cuts a text before merging (a fixed value of its vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, how often each occurs)."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), dtype=bool), x[1:] != x[:-1]]))
    return x[first], np.diff(first, append=len(x))


class Pieces:
    """Alignments of text pieces, remembered: counts of tokens, groups and links, the linked pairs, the groups as text.

    A piece is a space and ``key``; pieces are numbered as they come. What belongs to pieces lies end to end: their linked
    pairs as ``a * n_b + b``, and the strings that make up the text of their groups as numbers of ``self.strings``.
    """

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte = byte_of_character()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes([byte[c] for c in token]) if all(c in byte for c in token) else b""
        ranks = _ranks(path_a, self.bytes_a)
        self.fast_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.bytes_b = [self._bytes_b(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        ids = list(map(str, range(max(self.n_a, self.n_b))))
        self.strings = [mark + i for mark in ("", ";", ",", "|") for i in ids]
        self.tight = [c + " " for c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"]
        self.unsafe = re.compile(r"\s ")
        self.cut = re.compile(r"(?<=\S)(?= )")
        self.beyond_latin = re.compile("[^\x00-\u024f]")
        self.forget()

    def _bytes_b(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.counts = np.zeros((0, 4), dtype=np.int64)  # tokens of A, of B, groups, links
        self.wrong = np.zeros(0, dtype=bool)  # bytes differ from the text
        self.links, self.first_link = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.parts, self.first_part = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.texts: list[str] = []  # the groups of the pieces, as far as they were asked for
        self.sums = np.zeros((0, 3), dtype=np.int64)  # what the second pass looked up for them
        self.sums_of: object = None

    def keys(self, text: str) -> list[str]:
        """The pieces of a space and the text, each without its first space."""
        if text.startswith(" ") or (any(t in text for t in self.tight) if text.isascii() else self.unsafe.search(text)):
            return [p[1:] for p in self.cut.split(" " + text)]
        return text.split(" ")

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all pieces of all texts, end to end; where each text's begin)."""
        if len(self.number) > REMEMBERED:
            self.forget()
        keys = [self.keys(t) if t else [] for t in texts]
        self._learn(sorted(set().union(*keys).difference(self.number)))
        starts = np.cumsum([0, *map(len, keys)])
        return np.fromiter(map(self.number.__getitem__, chain.from_iterable(keys)), np.int64, starts[-1]), starts

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def add(keys: list[str], fast: bool) -> None:
            aligned = self._align(keys, fast)
            if aligned is None and len(keys) > 1:
                for k in keys:
                    add([k], fast)
                return
            self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys)), strict=True))
            counts, links, parts = aligned or (np.zeros((1, 4), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))
            found.append((counts, np.full(len(keys), aligned is None), links, parts))

        # pieces are encoded as one text where nothing but the cut between them can matter
        alone = [k for k in new if not k or k[-1].isspace() or len(k) > 1000]
        for k in alone:
            add([k], False)
        rest = sorted(set(new).difference(alone)) if alone else new
        for i in range(0, len(rest), 2000):
            some = rest[i : i + 2000]
            if not self.fast_a:
                add(some, False)
            elif not self.beyond_latin.search("".join(some)):
                add(some, True)
            else:
                for fast in (True, False):
                    kind = [k for k in some if (not self.beyond_latin.search(k)) == fast]
                    if kind:
                        add(kind, fast)
        counts, wrong, links, parts = zip((self.counts, self.wrong, self.links, self.parts), *found, strict=True)
        self.counts, self.wrong, self.links, self.parts = map(np.concatenate, (counts, wrong, links, parts))
        self.first_link = np.concatenate([[0], np.cumsum(self.counts[:, 3])])
        self.first_part = np.concatenate([[0], np.cumsum(self.counts[:, 0] + self.counts[:, 1])])

    def _align(self, keys: list[str], fast: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Counts, links and parts of the pieces, encoded as one text; None if its tokens' bytes are not the text's."""
        spaced = " " + " ".join(keys)
        a = self.fast_a.encode_ordinary(spaced) if fast else self.a.encode_batch_fast([spaced], add_special_tokens=False)[0].ids
        # an empty text has no tokens in B, not even the space; a lone space is what it is after a piece
        b = self.b.encode(spaced[1:]) if len(spaced) > 1 else self.b.encode("x ")[len(self.b.encode("x")) :]
        raw = spaced.encode("utf-8", "surrogatepass")
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        start_a, start_b = end_a - self.size_a[ids_a], end_b - self.size_b[ids_b]
        ends_here = np.zeros((2, len(raw) + 1), dtype=bool)
        ends_here[0, end_a] = ends_here[1, end_b] = True
        groups_to = np.cumsum(ends_here.all(axis=0))  # groups that have ended at a byte offset
        group_a, group_b = groups_to[start_a], groups_to[start_b]
        first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        n = last - first
        link_a = np.repeat(np.arange(len(a)), n)
        links = ids_a[link_a] * self.n_b + ids_b[_expand(first, n)]
        if len(keys) == 1:
            bounds = np.array([len(raw)])
        else:
            bounds = np.cumsum([1 + len(k) for k in keys] if len(raw) == len(spaced) else [1 + len(k.encode("utf-8", "surrogatepass")) for k in keys])
        at_a, at_b = np.searchsorted(end_a, bounds, "right"), np.searchsorted(end_b, bounds, "right")
        counts = np.diff(np.stack([at_a, at_b, groups_to[bounds], np.concatenate([[0], np.cumsum(n)])[at_a]], axis=1), axis=0, prepend=0)
        # the text of the groups: A's ids of a group, then B's; before each a mark that the ids before it decide
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids, group, of_b = np.concatenate([ids_a, ids_b])[order], np.concatenate([group_a, group_b])[order], order >= len(a)
        same_group, same_side = np.diff(group, prepend=-1) == 0, np.diff(of_b, prepend=True) == 0
        mark = np.where(same_group, np.where(same_side, 2, 3), 1)
        begins = np.concatenate([[0], (at_a + at_b)[:-1]])
        mark[begins] = 0
        return counts, links, (mark * (len(self.strings) // 4) + ids).astype(np.int32)

    def group_texts(self) -> list[str]:
        """The groups of every piece."""
        known = len(self.texts)
        if known < len(self.number):
            strings = list(map(self.strings.__getitem__, self.parts[self.first_part[known] :].tolist()))
            cuts = (self.first_part[known:] - self.first_part[known]).tolist()
            self.texts += ["".join(strings[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        return self.texts

    def look_up(self, index: Index) -> np.ndarray:
        """Best links, sum of counts and pairs that were not counted, of every piece; each is looked up once."""
        if self.sums_of is not index:
            self.sums_of, self.sums = index, self.sums[:0]
        known = len(self.sums)
        if known < len(self.number):
            n, best, counted = index.look_up(self.links[self.first_link[known] :])
            self.sums = np.concatenate([self.sums, _sums(np.stack([best.astype(np.int64), n, ~counted], axis=1), self.first_link[known:] - self.first_link[known])])
        return self.sums


_PIECES: dict[tuple, Pieces] = {}
_INDEX: dict[str, Index] = {}


def _pieces(*key: str) -> Pieces:
    """One set of remembered pieces per worker process: that of the last vocabularies."""
    if key not in _PIECES:
        _PIECES.clear()
        _PIECES[key] = Pieces(*key)
    return _PIECES[key]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(doc_ids, texts) with a bounded number of characters; a null text is empty."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            start, texts, held = at, [], 0
            while at < b.num_rows and held < CHARACTERS_AT_ONCE:
                texts.append(b.column("text")[at].as_py() or "")
                held += len(texts[-1])
                at += 1
            yield b.column("doc_id").slice(start, len(texts)), texts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches between ``starts``."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def _expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, .. (n of them) of every stretch, end to end."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _document_pairs(p: Pieces, numbers: np.ndarray, starts: np.ndarray, distinct: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, number of links) of each distinct pair of each document whose bytes are right.

    ``distinct``: the number is not wanted, so a piece that a document repeats is looked at once.
    """
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    right = _sums(p.wrong[numbers].astype(np.int64), starts) == 0
    doc, numbers = doc[right[doc]], numbers[right[doc]]
    if distinct:
        code, _ = _distinct(doc * len(p.number) + numbers)
        doc, numbers = code // max(len(p.number), 1), code % max(len(p.number), 1)
    n = p.counts[numbers, 3]
    pair = p.links[_expand(p.first_link[numbers], n)]
    span = p.n_a * p.n_b
    code, links = _distinct(np.repeat(doc, n) * span + pair)
    return code // span, code % span, links


def _count_partition(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """First pass: (part, pair, n) - how many of this task's documents hold the pair."""
    p, part = _pieces(*paths), TaskContext.get().partitionId()
    pairs, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), part, dtype=np.int32)), pa.array(pairs), pa.array(n)], ["part", "pair", "n"])

    for _, texts in _texts(batches):
        _, found, _ = _document_pairs(p, *p.numbers(texts), distinct=True)
        found, more = _distinct(found)
        pairs, n = np.concatenate([pairs, found]), np.concatenate([n, more])
        order = np.argsort(pairs, kind="stable")
        pairs, n = pairs[order], n[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        pairs, n = pairs[first], np.add.reduceat(n, first) if len(first) else n
        if len(pairs) > PAIRS_HELD:
            yield rows()
            pairs, n = pairs[:0], n[:0]
    yield rows()


def _build_shard(key: tuple, group: pa.Table) -> pa.Table:
    sizes, bits, keys = build(group.column("pair").to_numpy())
    return pa.table(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([sizes], pa.list_(pa.int32())), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([keys.tobytes()], pa.binary())],
        ["shard", "sizes", "bits", "keys"],
    )


class Index:
    """Hash functions, keys and counts of some shards, and the highest count of every id of A."""

    def __init__(self, rows: list[tuple], n_shards: int, best: np.ndarray, n_b: int):
        by_shard = {r[0]: r for r in rows}
        parts = [by_shard.get(s, (s, [], b"", b"", b"")) for s in range(n_shards)]
        self.keys = np.concatenate([np.frombuffer(r[3], dtype="<i8") for r in parts])
        self.counts = np.concatenate([np.frombuffer(r[4], dtype="<i8") for r in parts])
        self.hash = PerfectHash([list(r[1]) for r in parts], [np.unpackbits(np.frombuffer(r[2], dtype=np.uint8), count=sum(r[1])).astype(bool) for r in parts], [len(r[3]) // 8 for r in parts])
        self.best, self.n_b = best, n_b

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, whether it is the highest of its id of A, whether the pair was counted at all) of each pair."""
        if not len(self.keys):
            none = np.zeros(len(pairs), dtype=bool)
            return none.astype(np.int64), none, none
        at = self.hash.places(pairs)
        known = (at >= 0) & (self.keys[at] == pairs)
        n = np.where(known, self.counts[at], 0)
        return n, known & (n == self.best[pairs // self.n_b]), known


def _check_known(known: bool) -> None:
    if not known:
        raise ValueError("a pair was not counted in the first pass: the documents have changed between the passes")


def _one_shard(row: dict, best: np.ndarray, n_b: int) -> Index:
    return Index([(0, row["sizes"], row["bits"], row["keys"], row.get("counts") or b"")], 1, best, n_b)


def _beside_index(rows: DataFrame, index: DataFrame, salts: int) -> DataFrame:
    """``rows`` (shard, salt, ..) and a copy of the index's row of a shard for each salt, in one frame: partitions hold whole
    (shard, salt) groups, the index's row before the others."""
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = rows.unionByName(copies, allowMissingColumns=True)
    return both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("keys").isNull())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], dict | None, pa.RecordBatch | None]]:
    """((shard, salt), index row, None) when a group begins, then ((shard, salt), None, rows) for its rows."""
    for b in batches:
        head = b.column("keys").is_valid().to_numpy(zero_copy_only=False)
        marks = [*np.flatnonzero(head).tolist(), b.num_rows]
        if marks[0] > 0:
            yield (b.column("shard")[0].as_py(), b.column("salt")[0].as_py()), None, b.slice(0, marks[0])
        for i, j in zip(marks, marks[1:], strict=False):
            row = {c: b.column(c)[i].as_py() for c in b.schema.names}
            yield (row["shard"], row["salt"]), row, None
            if j > i + 1:
                yield (row["shard"], row["salt"]), None, b.slice(i + 1, j - i - 1)


def _dense_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First level: the dense vector of a shard from some tasks' rows."""
    group, index, vector = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group[0]], pa.int32()), pa.array([group[1]], pa.int32()), pa.array([vector.tobytes()], pa.binary())], ["shard", "salt", "vector"])

    for key, row, rows in _groups(batches):
        if row is not None:
            if group is not None:
                yield out()
            group, index = key, _one_shard(row, np.zeros(0), 1)
            vector = np.zeros(len(index.keys), dtype="<i8")
        else:
            pairs = rows.column("pair").to_numpy()
            at = index.hash.places(pairs)
            if (index.keys[at] != pairs).any():
                raise ValueError("a pair is missing from its shard")
            np.add.at(vector, at, rows.column("n").to_numpy())
    if group is not None:
        yield out()


def _add_vectors(key: tuple, group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_py(), dtype="<i8") for v in group.column("vector"))
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["shard", "salt", "vector"])


def _highest(batches: Iterator[pa.RecordBatch], n_b: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for keys, counts in zip(b.column("keys"), b.column("counts"), strict=True):
            a, n = np.frombuffer(keys.as_py(), dtype="<i8") // n_b, np.frombuffer(counts.as_py(), dtype="<i8")
            ids, at = np.unique(a, return_inverse=True)
            top = np.zeros(len(ids), dtype=np.int64)
            np.maximum.at(top, at, n)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(top)], ["a", "n"])


def count_pairs(documents: DataFrame, paths: tuple[str, str], scratch: Scratch) -> DataFrame:
    """The index of all pairs linked in any text: rows (shard, sizes, bits, keys, counts), one per shard, as written.

    ``keys`` and ``counts`` are 64-bit integers in the order of the shard's hash: ``a * n_b + b`` and the number of rows of
    ``documents`` that hold the pair linked.
    """
    parts = scratch.keep(documents.select("doc_id", "text").mapInArrow(lambda it: _count_partition(it, paths), "part int, pair long, n long"), "parts")
    pairs = scratch.keep(parts.select("pair").distinct(), "pairs")
    n_pairs, n_parts = pairs.count(), parts.count()
    n_shards = max(1, -(-n_pairs // SHARD_PAIRS))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(b.column("pair").to_numpy(), n_shards).astype(np.int32)), *b.columns], ["shard", *b.schema.names])

    functions = scratch.keep(
        pairs.mapInArrow(shards, "shard int, pair long").groupBy("shard").applyInArrow(_build_shard, "shard int, sizes array<int>, bits binary, keys binary"), "functions"
    )
    salts = max(1, -(-n_parts // (n_shards * ROWS_A_VECTOR)))
    rows = parts.mapInArrow(shards, "shard int, part int, pair long, n long").select("shard", (F.col("part") % salts).alias("salt"), "pair", "n")
    vectors = _beside_index(rows, functions, salts).mapInArrow(_dense_partition, "shard int, salt int, vector binary")
    vectors = scratch.keep(vectors, "vectors")
    while salts > 1:
        salts = -(-salts // FAN_IN)
        dealt = vectors.select("shard", F.floor(F.col("salt") / FAN_IN).cast("int").alias("salt"), "vector")
        vectors = scratch.keep(dealt.groupBy("shard", "salt").applyInArrow(_add_vectors, "shard int, salt int, vector binary"), "vectors")
    return scratch.keep(functions.join(vectors.select("shard", F.col("vector").alias("counts")), "shard").select(*[c.split()[0] for c in INDEX.split(", ")]), "index")


def _digest_batch(p: Pieces, doc_ids: pa.Array, numbers: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of some texts."""
    right = _sums(p.wrong[numbers].astype(np.int64), starts) == 0
    counts = _sums(p.counts[numbers], starts) * right[:, None]
    some, cuts = list(map(p.group_texts().__getitem__, numbers.tolist())), starts.tolist()
    digests = [hashlib.sha256(";".join(some[i:j]).encode()).hexdigest() if ok and j > i else "" for i, j, ok in zip(cuts, cuts[1:], right.tolist(), strict=False)]
    return [doc_ids, *[pa.array(counts[:, i]) for i in range(4)], pa.array(digests, pa.string())]


def _align_whole(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], index: Callable[[], Index]) -> Iterator[pa.RecordBatch]:
    """Second pass, the index at hand: a link's count is looked up once for each piece that is learnt."""
    p, found = _pieces(*paths), index()
    for doc_ids, texts in _texts(batches):
        numbers, starts = p.numbers(texts)
        columns = _digest_batch(p, doc_ids, numbers, starts)
        right = _sums(p.wrong[numbers].astype(np.int64), starts) == 0
        sums = _sums(p.look_up(found)[numbers], starts) * right[:, None]
        _check_known(not sums[:, 2].any())
        yield pa.RecordBatch.from_arrays([*columns[:5], pa.array(sums[:, 0]), pa.array(sums[:, 1]), columns[5]], [c.split()[0] for c in ALIGNED.split(", ")])


def _align_dealt(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], n_shards: int) -> Iterator[pa.RecordBatch]:
    """Second pass, the index elsewhere: each document's digest, and its pairs with their numbers of links by shard."""
    p = _pieces(*paths)
    kind = pa.list_(pa.struct([("shard", pa.int32()), ("pairs", pa.binary()), ("links", pa.binary())]))
    for doc_ids, texts in _texts(batches):
        numbers, starts = p.numbers(texts)
        doc, pairs, links = _document_pairs(p, numbers, starts, distinct=False)
        shard = shard_of(pairs, n_shards)
        order = np.lexsort((shard, doc))
        doc, pairs, links, shard = doc[order], pairs[order], links[order], shard[order]
        cuts = [*np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(shard, prepend=-1)).tolist(), len(doc)]
        dealt: list[list[dict]] = [[] for _ in texts]
        for i, j in zip(cuts, cuts[1:], strict=False):
            dealt[doc[i]].append({"shard": int(shard[i]), "pairs": pairs[i:j].tobytes(), "links": links[i:j].tobytes()})
        yield pa.RecordBatch.from_arrays([*_digest_batch(p, doc_ids, numbers, starts), pa.array(dealt, kind)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "dealt"])


def _look_up_partition(batches: Iterator[pa.RecordBatch], best: np.ndarray, n_b: int) -> Iterator[pa.RecordBatch]:
    """(row, n_best, count_sum) of the pairs dealt to a shard, from that shard's part of the index."""
    index = None
    for _, head, rows in _groups(batches):
        if head is not None:
            index = _one_shard(head, best, n_b)
            continue
        at, sums = rows.column("row").to_numpy(), np.zeros((rows.num_rows, 2), dtype=np.int64)
        for i, (pairs, links) in enumerate(zip(rows.column("pairs"), rows.column("links"), strict=True)):
            n, top, counted = index.look_up(np.frombuffer(pairs.as_py(), dtype="<i8"))
            _check_known(counted.all())
            links = np.frombuffer(links.as_py(), dtype="<i8")
            sums[i] = (links * top).sum(), (links * n).sum()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["row", "n_best", "count_sum"])


def align(spark: SparkSession, documents: DataFrame, path_a: str | None = None, path_b: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best``: links whose pair's count is the highest that any pair of the same id of A has, ties included;
    ``count_sum``: the sum of the counts over all links; ``groups_sha256``: of ``a1,a2|b1;a3|b2,b3`` with the decimal ids in
    order. A text that is null or empty, or that either tokenizer does not give back byte by byte, has no tokens: zeros,
    and an empty string for the digest. Special tokens' strings inside texts are plain text. A null doc_id stays null; rows
    of the same id or text count as documents of their own; extra columns are ignored; no rows give none. ``path_a`` and
    ``path_b`` are the vocabulary files (default: the public ones this module names), which workers open.
    """
    import public_tokenizers

    paths = (path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B))
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(spark, "align")
    index = count_pairs(documents, paths, scratch)
    pieces = Pieces(*paths)
    n_a, n_b = pieces.n_a, pieces.n_b
    best = np.zeros(n_a, dtype=np.int64)
    for r in index.select("keys", "counts").mapInArrow(lambda it: _highest(it, n_b), "a long, n long").groupBy("a").agg(F.max("n").alias("n")).collect():
        best[r.a] = r.n  # one row per id of A at most
    n_shards, n_bytes = index.agg(F.count("*"), F.coalesce(F.sum(F.length("keys") + F.length("counts") + F.length("bits")), F.lit(0))).first()
    if n_bytes <= broadcast_bytes:
        token = scratch.root
        held = spark.sparkContext.broadcast(([tuple(r) for r in index.select(*[c.split()[0] for c in INDEX.split(", ")]).collect()], best))

        def whole() -> Index:
            """One per worker process and run."""
            if token not in _INDEX:
                _INDEX.clear()
                rows, top = held.value
                _INDEX[token] = Index(rows, max(1, n_shards), top, n_b)
            return _INDEX[token]

        return documents.mapInArrow(lambda it: _align_whole(it, paths, whole), ALIGNED)
    aligned = documents.mapInArrow(
        lambda it: _align_dealt(it, paths, n_shards), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, dealt array<struct<shard:int,pairs:binary,links:binary>>"
    )
    aligned = scratch.keep(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    n_dealt = aligned.agg(F.coalesce(F.sum(F.size("dealt")), F.lit(0))).first()[0]
    salts = max(1, -(-n_dealt // (n_shards * ROWS_A_SALT)))
    dealt = aligned.select("row", F.explode("dealt").alias("d")).select("row", "d.*").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    sums = _beside_index(dealt, index, salts).mapInArrow(lambda it: _look_up_partition(it, best, n_b), "row long, n_best long, count_sum long")
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("dealt").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
