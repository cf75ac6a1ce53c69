"""Token-ID / binary output (operator 8): ORC files of token ids, in document order, and their reader.

Documents are range-partitioned and sorted by id, encoded where they stand, and written as one ORC file per partition:
integer columns in run-length encoding (the ids as an int list), a row index every ``ROW_STRIDE`` rows and a Bloom filter
on ``doc_id``. Stripes can be read in parallel; a reader that asks for some ids skips files, stripes and row groups by
their statistics and Bloom filters. A row knows its place inside its file, so a document's start is the sum of the files
before plus that: one small sum per file, no sort of the ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, broadcast_below

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
ROW_STRIDE = 5_000
STRIPE_BYTES = 16 << 20
CACHE_ENTRIES = 400_000  # words in each of two generations
CHARACTERS_AT_ONCE = 2 << 20
SCHEMA = "doc_id long, shard int, at long, n_tokens long, ids array<int>"

_ENCODERS: dict[str, Encoder] = {}


class Encoder(dict):
    """Encodes whole texts with a vocabulary of the tokenizers library, each distinct word once while it is remembered.

    The library's byte-level pattern never joins characters over a space that a non-space follows, so a text may be cut
    there and the words encoded alone. Texts that hold a special token's string are encoded whole. Of a word made of Latin
    letters and ASCII marks after them, maybe over one line end, the pattern keeps each run of letters and of marks whole,
    so the runs go to the vocabulary's merges at once; other words go through the whole encoder. A single line end between
    two characters that are no white space is a piece of its own, so a text whose spaces and line ends all stand alone is
    cut at both, and the words around a line end are not met as one.

    As a dict it holds the ids of the words met lately, and finds those of others on demand. They are kept in two
    generations: a full one becomes the old one, and words met again come back from there. A key is the word without the
    space before it; the first word of a text, which has none, has a space before its key, one after a line end that line end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.space = re.compile(r" (?:\s|$)")
        self.odd = re.compile(r"[ \n](?:\s|$)|\s\n")  # two white spaces of which one is a space or line end, or one at the end
        self.cut = re.compile(r" (?=\S)")
        letters, marks = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+", r"[!-/:-@\[-`{-~]*"
        self.runs = re.compile(rf"({letters})({marks})(?:\n({letters})({marks}))?").fullmatch
        self.stand_in = str.maketrans({chr(b): c for c, b in byte_of_character().items()})
        self.marks: dict[str, bytes] = {"": b""}
        self.line_end = self._run("\n")
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        (e,) = self.tok.encode_batch_fast([text], add_special_tokens=False)
        return array("I", e.ids).tobytes()

    def _run(self, run: str) -> bytes:
        """The ids of a run that the pattern keeps whole."""
        return b"".join([self.bytes_of[t.id] for t in self.merge(run.encode().decode("latin-1").translate(self.stand_in))])

    def _marks(self, run: str) -> bytes:
        if run not in self.marks:
            if len(self.marks) > CACHE_ENTRIES:
                self.marks = {"": b""}
            self.marks[run] = self._run(run)
        return self.marks[run]

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            bare = key[:1] in (" ", "\n")  # no space before the word
            word = key[1:] if bare else key
            m = self.runs(word)
            if m is None:
                ids = self._whole(word if bare else " " + word)
            else:
                head, mark, tail, last = m.groups()
                if bare:
                    ids = self._run(head)
                else:
                    ids = self.get(head) if mark or tail else None  # the word without its marks may be known
                if ids is None:  # printable ASCII stands for itself, U+0120 for the space
                    ids = b"".join([self.bytes_of[t.id] for t in self.merge("\u0120" + head)]) if head.isascii() else self._run(" " + head)
                if mark:
                    ids += self._marks(mark)
                if tail is not None:
                    ids += self.line_end + self._run(tail) + self._marks(last)
            if key[:1] == "\n":
                ids = self.line_end + ids
        self[key] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers, without an end id."""
        if any(s in text for s in self.special):
            return self._whole(text)
        if self._plain(text):
            keys = text.replace("\n", " \n").split(" ")
        else:
            keys = self.cut.split(text) if self.space.search(text) else text.split(" ")
        keys[0] = " " + keys[0]
        out = b"".join(map(self.__getitem__, keys))
        self._age()
        return out

    def _age(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()

    def _plain(self, text: str) -> bool:
        """Whether all spaces and line ends of a text stand alone between other characters."""
        flat = text.replace("\n", " ")
        if flat.isprintable():  # so it has no other white space
            return "  " not in flat and flat[-1:] != " "
        return not self.odd.search(text)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, an end id after each, end to end, and their number per text.

        The words after the first of all texts that may be cut are split and numbered as one Arrow array, so each distinct one
        is looked up once.
        """
        first, rests, counts = [], [], []
        for text in texts:
            rest = None
            if not self._plain(text) or any(s in text for s in self.special):
                first.append(self.encode(text))
            else:
                word, _, rest = text.replace("\n", " \n").partition(" ")
                first.append(self[" " + word])
            counts.append(rest.count(" ") + 1 if rest else 0)
            if rest:
                rests.append(rest)
        words = pc.split_pattern(pa.array([" ".join(rests)][: len(rests)], pa.large_string()), " ").flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*map(self.__getitem__, distinct), *first, END_ID.to_bytes(4, "little")]
        self._age()
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(ids), dtype="<i4"))
        n, ends = len(texts), np.cumsum(counts)
        around = np.stack([np.arange(len(ids) - 1 - n, len(ids) - 1), np.full(n, len(ids) - 1)], axis=1).ravel()
        order = np.insert(words.indices.to_numpy(), np.stack([ends - counts, ends], axis=1).ravel(), around)
        total = np.cumsum(sizes[order])[np.cumsum(np.array(counts) + 2) - 1]
        return lists.take(pa.array(order)).flatten().to_numpy(), np.diff(total, prepend=0)


def byte_of_character() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode_partition(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc, shard, at = encoder(path), TaskContext.get().partitionId(), 0

    def flush(doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        nonlocal at
        values, n = enc.encode_all(texts)
        offsets = np.concatenate([[0], np.cumsum(n)])
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
        out = [doc_ids, pa.array(np.full(len(n), shard, dtype=np.int32)), pa.array(at + offsets[:-1]), pa.array(n), lists]
        at += int(offsets[-1])
        return pa.RecordBatch.from_arrays(out, ["doc_id", "shard", "at", "n_tokens", "ids"])

    for b in batches:
        first = 0
        while first < b.num_rows:  # pieces of a bounded number of characters; a longer text goes alone
            texts, held = [], 0
            while first + len(texts) < b.num_rows and held < CHARACTERS_AT_ONCE:
                texts.append(b.column("text")[first + len(texts)].as_py() or "")
                held += len(texts[-1])
            yield flush(b.column("doc_id").slice(first, len(texts)), texts)
            first += len(texts)


def write_tokens(documents: DataFrame, path: str, vocabulary: str) -> None:
    """Write the token ids of every document, an end id after each, as ORC files in ascending order of doc_id.

    A null id comes first; of rows of the same id those without a text come first, then they are ordered by a digest of the
    text; a null text is an empty one (the end id alone). A range of files may cut the rows of one id, and equal rows too, so
    an id that holds many rows makes no large file. Extra columns are ignored; no documents make a folder without rows.
    """
    order = ["doc_id", F.col("text").isNotNull(), F.xxhash64("text"), "place"]
    (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(lambda it: _encode_partition(it, vocabulary), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(ROW_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ``doc_ids`` is pushed down to statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    size = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = size.select("shard", before.alias("base"))  # one row per file
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    n_bytes = 64 * len(rows.inputFiles())
    return rows.join(broadcast_below(base, n_bytes), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            off, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            crc = [zlib.crc32(values[off[i] : off[i + 1]].astype("<u4").tobytes()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the files to the shared folder and return the digest of what they hold, one row per document row."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    path = Scratch(spark, "tokens").path("orc")
    write_tokens(documents, path, vocabulary)
    return digest(read_tokens(spark, path))
