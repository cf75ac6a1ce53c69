"""Exact top-k search (operator 2): BM25 over sharded inverted indexes with block-max WAND pruning.

Each shard of documents - as many as a task reads one after the other until they hold ``SHARD_BYTES`` of text, so texts are
not shuffled and a shard's size does not depend on how many documents it is - gets an inverted index (postings by term, in
order of document). Document frequencies and the mean length are summed over all shards, so a score does not depend on the
shard. Queries come in blocks of bounded size; a block is sent to all shards, and its queries are searched in groups that
are alike. The posting lists of a shard with the most documents are laid out densely, with the largest weight of every block
of ``BLOCK`` documents. Per group, lists that enough of its queries have are left to a matrix product; what the others
contribute is added up for all documents. The pivot test is made for blocks of documents: a query's bound there is the
largest sum of the added lists and the block maxima of the dense ones, and a block is passed over if that does not reach the
k-th best score so far; matrix products score the others. Blocks are taken in order of their bounds, in steps that double,
and the threshold rises after every step and goes on to the task's next shard. Products are in single precision, with a
margin for their rounding; what passes is scored again in double precision, term by term. One shard of ``LEAD`` is searched
first, and its k-th best scores are the thresholds that the tasks of all others begin with. Each task returns its best k per
query, and the global best k of those are exact.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

K, K1, B = 10, 1.2, 0.75
SHARD_BYTES, BLOCK = 12 << 20, 32
DENSE, WIDER = 32, 2  # dense lists; lists of that many times fewer documents are laid out too
WORTH = 1000  # adding a posting takes as long as so many products of a matrix product
QUERIES_AT_ONCE, TERMS_AT_ONCE, ADD_AT_ONCE = 256, 1 << 17, 32
LIKENESS, DOCS_AT_ONCE = 128, 512
FEW = 8  # a block is scored for all queries of a group if one of so many needs it
FIRST_BLOCKS = 8  # scored first; then twice as many in each step
LEAD = 16  # one shard of so many is searched first, to have thresholds for the others
QUERY_TERMS = 1_500_000  # (query, term) rows in a block of queries
COUNT_BYTES = 1 << 20
BY = 100
HITS = "query_id long, doc_id long, score double"
#: Words are runs of letters, digits and non-ASCII characters; A-Z count as lower case.
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def term_key(word: bytes) -> int:
    """A term's signed 64-bit key (xxhash); two terms of a corpus share one with a chance of about n^2 / 2^65."""
    import xxhash

    return xxhash.xxh64_intdigest(word) - (1 << 63)


def pack(**arrays: np.ndarray) -> bytes:
    """A line with the arrays' names, types and lengths, then their numbers."""
    head = json.dumps([(k, v.dtype.str, len(v)) for k, v in arrays.items()]).encode()
    return b"\n".join([head + b" " * (-len(head) % 8 + 7), b"".join(v.tobytes() + b" " * (-v.nbytes % 8) for v in arrays.values())])


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    at = blob.index(b"\n")
    out, names = {}, json.loads(blob[:at])
    at += 1
    for name, kind, n in names:
        out[name] = np.frombuffer(blob, dtype=kind, count=n, offset=at)
        at += out[name].nbytes + -out[name].nbytes % 8
    return out


class Counts(NamedTuple):
    """Of some texts: their different words; by text and word, how often; the texts' lengths in words."""

    words: list[bytes]
    doc: np.ndarray
    word: np.ndarray
    tf: np.ndarray
    length: np.ndarray


def count(texts: list[bytes | None]) -> Counts:
    """The words of ``terms_of``, of ``COUNT_BYTES`` of text at once."""
    vocab: dict[bytes, int] = {}
    ends = np.cumsum([0, *(len(t or b"") for t in texts)], dtype=np.int64)
    none = np.zeros(0, dtype=np.int32)
    parts = [(none, none, none)]
    i = 0
    while i < len(texts):
        j = max(int(np.searchsorted(ends, ends[i] + COUNT_BYTES, "right")) - 1, i + 1)
        data = b"".join(t or b"" for t in texts[i:j]).translate(_WORDS)
        split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(ends[i : j + 1] - ends[i]), pa.py_buffer(data)]))
        coded = split.values.dictionary_encode()
        _, at, chars = coded.dictionary.buffers()
        at = np.frombuffer(at, dtype=np.int64)[: len(coded.dictionary) + 1].tolist() if len(coded.dictionary) else [0]
        chars = chars.to_pybytes() if chars is not None else b""
        words = [chars[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        cell = np.repeat(np.arange(j - i), np.diff(split.offsets.to_numpy())) * max(len(words), 1)
        cell += coded.indices.to_numpy()
        cell, tf = np.unique(cell, return_counts=True)
        doc, word = np.divmod(cell, max(len(words), 1))
        if b"" in words:  # white space at a text's ends
            some = word != words.index(b"")
            doc, word, tf = doc[some], word[some], tf[some]
        number = np.array([vocab.setdefault(w, len(vocab)) if w else -1 for w in words], dtype=np.int32)
        parts.append(((doc + i).astype(np.int32), number[word], tf.astype(np.int32)))
        i = j
    doc, word, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Counts(list(vocab), doc, word, tf, np.bincount(doc, weights=tf, minlength=len(texts)).astype(np.int64))


def by_term(counts: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term keys in order, where each term's postings start, their documents and frequencies."""
    keys, place = np.unique(np.array([term_key(w) for w in counts.words], dtype=np.int64), return_inverse=True)
    term = place[counts.word]
    start = np.append(0, np.cumsum(np.bincount(term, minlength=len(keys))))
    order = np.argsort(term * len(counts.length) + counts.doc, kind="stable")
    return keys, start, counts.doc[order], counts.tf[order]


def postings(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: term keys in order, where each term's postings start, their documents and frequencies, lengths."""
    counts = count(texts)
    return *by_term(counts), counts.length


def alike(texts: list[bytes | None], counts: Counts | None = None) -> np.ndarray:
    """An order of texts in which neighbours share their most frequent word and their length, for tight block maxima.
    Texts that are not counted are read one by one, so that no text's words are kept."""

    def kind(text: bytes | None) -> tuple[bytes, int]:
        words = terms_of(text)
        return max(Counter(words).items(), key=lambda x: (x[1], x[0]))[0] if words else b"", len(words)

    if counts is None:
        kinds = [kind(t) for t in texts]
    else:
        most = np.zeros(len(texts), dtype=np.int32)
        np.maximum.at(most, counts.doc, counts.tf)
        word = [b""] * len(texts)
        top = np.flatnonzero(counts.tf == most[counts.doc])
        for i, w in zip(counts.doc[top].tolist(), counts.word[top].tolist(), strict=True):
            word[i] = max(word[i], counts.words[w])
        kinds = list(zip(word, counts.length.tolist(), strict=True))
    return np.array(sorted(range(len(texts)), key=lambda i: (*kinds[i], i)), dtype=np.int64)


class Queries:
    """A block of queries as (query, term key, gain) rows; neighbours are alike, so that they share blocks and dense lists.

    ``vocabulary`` holds the block's term keys in order and ``term`` each row's place there, so that a shard looks up a
    key once for all queries. The rows of query ``ids[i]`` are those from ``first[i]`` to ``first[i + 1]``, in order of key.
    """

    def __init__(self, q: np.ndarray, key: np.ndarray, gain: np.ndarray):
        order = np.lexsort((key, q))
        q, key, gain = q[order], key[order], gain[order]
        ids, first, n = np.unique(q, return_index=True, return_counts=True)
        vocabulary, term, in_queries = np.unique(key, return_inverse=True, return_counts=True)
        rank = likeness(np.repeat(np.arange(len(ids)), n), term, gain, in_queries)
        rows = ranges(first[rank], first[rank] + n[rank])
        self.ids, self.first = ids[rank], np.append(0, np.cumsum(n[rank]))
        self.vocabulary, self.term, self.gain = vocabulary, term[rows].astype(np.int32), gain[rows]
        # a query whose id is repeated can have a key twice
        self.last = np.append((q[1:] != q[:-1]) | (key[1:] != key[:-1]), np.ones(min(len(q), 1), dtype=bool))[rows]

    def groups(self) -> Iterator[tuple[int, int]]:
        """Ranges of queries, of at most ``QUERIES_AT_ONCE`` queries and ``TERMS_AT_ONCE`` rows (or one query)."""
        i = 0
        while i < len(self.ids):
            j = int(np.searchsorted(self.first, self.first[i] + TERMS_AT_ONCE, "right")) - 1
            j = min(max(j, i + 1), i + QUERIES_AT_ONCE, len(self.ids))
            yield i, j
            i = j


def likeness(query: np.ndarray, term: np.ndarray, gain: np.ndarray, in_queries: np.ndarray) -> np.ndarray:
    """An order of queries in which neighbours are alike: by what the ``LIKENESS`` terms that count most in all of them
    give each, they are split at the mean of their main direction, again and again."""
    most = np.argsort(-np.bincount(term, weights=gain, minlength=len(in_queries)) * (in_queries > 1), kind="stable")[:LIKENESS]
    column = np.full(len(in_queries), -1)
    column[most] = np.arange(len(most))
    some = column[term] >= 0
    vectors = np.zeros((query[-1] + 1 if len(query) else 0, len(most)))
    vectors[query[some], column[term[some]]] = gain[some]
    vectors /= np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-9)
    parts, out = [np.arange(len(vectors))], [np.zeros(0, dtype=np.int64)]
    while parts:
        part = parts.pop()
        if len(part) > QUERIES_AT_ONCE // 2:
            x = vectors[part] - vectors[part].mean(axis=0)
            side = x @ np.linalg.eigh(x.T @ x)[1][:, -1] > 0
            if side.any() and not side.all():
                parts += [part[side], part[~side]]
                continue
        out.append(part)
    return np.concatenate(out)


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All integers of the ranges [lo, hi), one range after the other."""
    n = hi - lo
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(lo - end + n, n)


class Shard:
    """One shard's index with the weights of its postings, once the corpus mean length is known."""

    def __init__(self, blob: bytes, mean: float):
        a = unpack(blob)
        self.ids, self.keys, self.start, length = a["ids"], a["keys"], a["start"], a["length"]
        self.doc = a["doc"].astype(np.int32)
        tf = a.pop("tf").astype(np.float64)
        norm = K1 * (1 - B + B * length / max(mean, 1e-9))
        self.weight = tf * (K1 + 1)
        tf += norm[self.doc]
        self.weight /= tf
        del a, tf
        self.n_docs = len(length)
        self.block = min(BLOCK, max(self.n_docs, 1))
        self.n_blocks = 1 + (max(self.n_docs, 1) - 1) // self.block
        self.n = np.diff(self.start)
        self.dense = self.n * DENSE >= max(self.n_docs, 1)
        # lists laid out by list, block and document: at most DENSE * WIDER times as many numbers as postings, twice that
        # where the last block has few documents; and the largest weight of each list and block
        laid = np.flatnonzero(self.n * (DENSE * WIDER) >= max(self.n_docs, 1))
        self.column = np.full(len(self.keys), -1, dtype=np.int32)
        self.column[laid] = np.arange(len(laid))
        self.matrix = np.zeros((len(laid), self.n_blocks, self.block), dtype=np.float32)
        post = ranges(self.start[laid], self.start[laid + 1])
        self.matrix.reshape(len(laid), self.n_blocks * self.block)[np.repeat(np.arange(len(laid)), self.n[laid]), self.doc[post]] = self.weight[post]
        self.largest = self.matrix.max(axis=2)
        # a posting's document and weight side by side
        both = np.empty((len(self.doc), 2), dtype=np.int32)
        both[:, 0], both[:, 1] = self.doc, self.weight.astype(np.float32).view(np.int32)
        self.both = both.reshape(-1).view(np.int64)

    def search(self, queries: Queries | list[tuple[np.ndarray, np.ndarray]], k: int, thetas: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (sorted term keys, their gains): (documents, scores) of at most the best k by score, then by id.
        Documents that score less than the query's theta need not be found."""
        q = np.repeat(np.arange(len(queries)), [len(keys) for keys, _ in queries])
        block = Queries(q, np.concatenate([x for x, _ in queries]), np.concatenate([x for _, x in queries]))
        query, ids, score = self.find(block, k, np.asarray(thetas, dtype=np.float64)[block.ids])
        query = block.ids[query]
        return [(ids[query == i], score[query == i]) for i in range(len(queries))]

    def find(self, queries: Queries, k: int, thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of at most the best k of each query, by query, score and id."""
        place = np.searchsorted(self.keys, queries.vocabulary)
        place[place == len(self.keys)] = 0
        place = np.where(self.keys[place] == queries.vocabulary, place, -1) if len(self.keys) else np.full(len(place), -1)
        at = place.astype(np.int32)[queries.term]
        here = at >= 0
        here[here] = queries.last[here] | ~self.dense[at[here]]  # of a query's gains for one key, a dense list counts the last
        at, gain, first = at[here], queries.gain[here], np.append(0, np.cumsum(here))[queries.first]
        pairs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, j in queries.groups():
            rows = slice(first[i], first[j])
            found, docs = self._group(np.diff(first[i : j + 1]), at[rows], gain[rows], k, thetas[i:j])
            pairs[0].append(found + i)
            pairs[1].append(docs)
        query, doc = (np.concatenate(x) for x in pairs)
        if not len(query):
            return query, self.ids[doc], np.zeros(0)
        return best_of_each(query, self.ids[doc], self._scores(first, at, gain, query, doc), k)

    def _group(self, lists: np.ndarray, at: np.ndarray, gain: np.ndarray, k: int, thetas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, document), in this order, of all that can be among the best k, from scores with an error below ``slip``.
        ``lists`` has how many of the lists in ``at`` each query has."""
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not len(at):
            return none
        n = len(lists)
        query = np.repeat(np.arange(n), lists)
        slip = 2.0**-22 * (lists + 8.0)  # each sum's roundings in single precision, twice over
        # a dense list serves in the product if enough of the group's queries have it, else it is added like the others
        column = self.column[at]
        often = np.bincount(column[column >= 0], minlength=len(self.matrix))
        use = np.zeros(len(self.matrix) + 1, dtype=bool)  # its last place is that of no column
        np.greater_equal(often * WORTH * self.n[self.column >= 0], n * self.n_docs, out=use[:-1])
        use[:-1] &= often > 0
        dense = use[column]
        cols = np.flatnonzero(use)
        gains = np.zeros((n, len(cols)), dtype=np.float32)
        gains[query[dense], (np.cumsum(use) - 1)[column[dense]]] = gain[dense]
        part = self._add(n, query[~dense], at[~dense], gain[~dense])
        bound = part.max(axis=2)
        bound += gains @ self.largest[cols]
        bound *= 1 + 2 * slip[:, None].astype(np.float32)
        low = thetas * (1 - slip)
        best = np.zeros((n, k), dtype=np.float32)  # the largest scores of blocks so far: as many documents reach them
        order = np.argsort(-bound.max(axis=0), kind="stable")
        step = max(FIRST_BLOCKS, -(-k // self.block))
        kept = [none]
        while len(order):
            some, order = order[:step], order[step:]
            step *= 2
            alive = (bound[:, some] >= low[:, None]) & (bound[:, some] > 0)
            many = alive.sum(axis=0) * FEW >= n
            # blocks that many queries need are scored for all of the group, the others for those that need one of them
            for rows, blocks in ((np.arange(n), some[many]), (np.flatnonzero(alive[:, ~many].any(axis=1)), some[~many & alive.any(axis=0)])):
                if not len(rows) or not len(blocks):
                    continue
                blocks = np.sort(blocks)
                score = (gains[rows] @ self.matrix[cols[:, None], blocks].reshape(len(cols), len(blocks) * self.block)).reshape(len(rows), len(blocks), self.block)
                score += part[rows[:, None], blocks]
                top = score.max(axis=2)
                high = np.concatenate([best[rows], top], axis=1)
                best[rows] = np.partition(high, high.shape[1] - k, axis=1)[:, -k:]
                low = np.maximum(low, best.min(axis=1) * (1 - slip) ** 2)
                r, b = np.nonzero((top >= low[rows, None]) & (top > 0))
                near = score[r, b]
                x, d = np.nonzero((near >= low[rows[r], None]) & (near > 0))
                kept.append((rows[r[x]], blocks[b[x]] * self.block + d, near[x, d]))
        kept = kept[1:] or [(*none, np.zeros(0))]
        q, doc, score = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((-score, q))
        q, doc, score = q[order], doc[order], score[order]
        at = np.searchsorted(q, np.arange(n)) + k - 1  # a query's k-th best
        full = np.flatnonzero(at < np.searchsorted(q, np.arange(n), "right"))
        low[full] = np.maximum(low[full], score[at[full]] * (1 - slip[full]) ** 2)
        near = score >= low[q]
        return q[near], doc[near]

    def _add(self, n: int, query: np.ndarray, at: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """What the lists that are not laid out contribute: by query, block and document."""
        width = self.n_blocks * self.block
        out = np.zeros((n, width), dtype=np.float32)
        first = np.searchsorted(query, np.arange(0, n + ADD_AT_ONCE, ADD_AT_ONCE))
        for i, lo, hi in zip(range(0, n, ADD_AT_ONCE), first[:-1], first[1:], strict=False):
            a = at[lo:hi]
            post = ranges(self.start[a], self.start[a + 1])
            both = self.both[post]
            cell = np.repeat((query[lo:hi] - i) * width, self.n[a])
            cell += both.view(np.int32)[::2]
            value = np.repeat(gain[lo:hi], self.n[a])
            value *= both.view(np.float32)[1::2]
            some = out[i : i + ADD_AT_ONCE]
            some[:] = np.bincount(cell, weights=value, minlength=some.size).reshape(some.shape)
        return out.reshape(n, self.n_blocks, self.block)

    def _scores(self, first: np.ndarray, at: np.ndarray, gain: np.ndarray, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The score of each pair (sorted by query): summed in order of key, so that documents that are alike score alike.
        The lists of query i are those from ``first[i]`` to ``first[i + 1]``."""
        weights = np.zeros(len(self.keys))
        out = np.zeros(len(query))
        order = np.argsort(doc, kind="stable")
        each, begin = np.unique(doc[order], return_index=True)
        begin = np.append(begin, len(order))
        for lo in range(0, len(each), DOCS_AT_ONCE):
            some = each[lo : lo + DOCS_AT_ONCE]
            place = np.full(self.n_docs, -1, dtype=np.int32)
            place[some] = np.arange(len(some))
            post = np.flatnonzero(place[self.doc] >= 0)
            of = place[self.doc[post]].astype(np.uint16)
            start = np.append(0, np.cumsum(np.bincount(of, minlength=len(some))))
            by_doc = np.argsort(of, kind="stable")  # lists are in order of key already
            term, weight = (np.searchsorted(self.start, post, "right") - 1)[by_doc], self.weight[post[by_doc]]
            for i in range(len(some)):
                its = slice(start[i], start[i + 1])
                weights[term[its]] = weight[its]
                for x in range(begin[lo + i], begin[lo + i + 1], ADD_AT_ONCE):
                    pairs = order[x : min(x + ADD_AT_ONCE, begin[lo + i + 1])]
                    a, b = first[query[pairs]], first[query[pairs] + 1]
                    rows = ranges(a, b)
                    out[pairs] = np.bincount(np.repeat(np.arange(len(pairs)), b - a), weights=gain[rows] * weights[at[rows]], minlength=len(pairs))
                weights[term[its]] = 0
        return out


def best_of(doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k by score, ties by document."""
    _, doc, score = best_of_each(np.zeros(len(doc), dtype=np.int64), doc, score, k)
    return doc, score


def best_of_each(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query by score, ties by document; in order of query, score and document."""
    order = np.lexsort((doc, -score, query))
    query = query[order]
    few = np.arange(len(order)) - np.searchsorted(query, query) < k
    return query[few], doc[order[few]], score[order[few]]


def _index_of(ids: list[int], texts: list[bytes | None], lead: bool = False) -> pa.RecordBatch:
    counts = count(texts)
    order = alike(texts, counts)
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order))
    length = counts.length[order]
    keys, start, doc, tf = by_term(counts._replace(doc=place[counts.doc], length=length))
    small, few = (np.uint16 if x < 1 << 16 else np.int32 for x in (len(ids), tf.max(initial=0)))
    blob = pack(ids=np.array(ids, dtype=np.int64)[order], keys=keys, start=start, doc=doc.astype(small), tf=tf.astype(few), length=length)
    return pa.RecordBatch.from_arrays(
        [pa.array([len(ids)], pa.int64()), pa.array([int(length.sum())], pa.int64()), pa.array([lead]), pa.array([keys], pa.list_(pa.int64())), pa.array([np.diff(start)], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
        ["n_docs", "n_words", "lead", "keys", "dfs", "blob"],
    )


def build_index(scratch: Scratch, documents: DataFrame) -> DataFrame:
    """(n_docs, n_words, lead, keys, dfs, blob): one index per shard of the documents that have an id."""

    def shard(ids: list[int], texts: list[bytes | None]) -> pa.RecordBatch:
        return _index_of(ids, texts, term_key(str(ids[0]).encode()) % LEAD == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                buffer = t.as_buffer()
                ids.append(d)
                texts.append(buffer.to_pybytes() if buffer is not None else None)
                held += len(texts[-1] or b"")
                if held >= SHARD_BYTES or len(ids) >= 1 << 20:
                    yield shard(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield shard(ids, texts)

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scratch.keep(rows.mapInArrow(run, "n_docs long, n_words long, lead boolean, keys array<long>, dfs array<long>, blob binary"), "index")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, key, qtf) of the queries' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, t in zip(b.column("query_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                keys, start, _, tf, _ = postings([t.as_py()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), q, dtype=np.int64)), pa.array(keys), pa.array(tf.astype(np.int64))], ["query_id", "key", "qtf"])

    return queries.mapInArrow(run, "query_id long, key long, qtf long")


def search_shards(batches: Iterator[pa.RecordBatch], queries: Queries | tuple[np.ndarray, np.ndarray, np.ndarray], mean: float, k: int, thetas: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of a task's shards for every query; ``queries`` may be (query, term key, gain). What scores less than
    the query's theta may be left out."""
    queries = queries if isinstance(queries, Queries) else Queries(*queries)
    thetas = np.zeros(len(queries.ids)) if thetas is None else thetas.copy()
    query, doc, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    for b in batches:
        for blob in b.column("blob"):
            shard = Shard(blob.as_py(), mean)
            # a k-th best score bounds the final one from below
            x, y, z = shard.find(queries, k, thetas)
            del shard  # before the next one is read
            if len(x):
                query, doc, score = best_of_each(np.concatenate([query, x]), np.concatenate([doc, y]), np.concatenate([score, z]), k)
                full = np.flatnonzero(np.bincount(query, minlength=len(thetas)) == k)
                last = np.searchsorted(query, full, "right") - 1
                thetas[full] = np.maximum(thetas[full], score[last] * (1 - 1e-12))
    yield pa.RecordBatch.from_arrays([pa.array(queries.ids[query]), pa.array(doc), pa.array(score)], ["query_id", "doc_id", "score"])


def search(spark: SparkSession, documents: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, doc_id, score: the ``k`` best documents of every query by BM25 (k1 1.2, b 0.75), ties by doc_id.

    ``queries(query_id, text)`` are whole texts; a term counts as often as the query has it, with
    ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``. Documents that share no term with a query are not results; a null or
    empty query has none. Rows without an id are left out; repeated ids are results of their own. Extra columns are
    ignored.
    """
    scratch = Scratch(spark, "bm25")
    index = build_index(scratch, documents)
    n_docs, n_words = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    terms = scratch.keep(query_terms(queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "text")), "terms")
    df = index.select(F.explode(F.arrays_zip("keys", "dfs")).alias("z")).select("z.keys", "z.dfs").groupBy("keys").agg(F.sum("dfs").alias("df"))
    n_terms = terms.count()
    blocks = 1 + n_terms // QUERY_TERMS
    idf = F.log1p((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, F.col("key") == F.col("keys")).select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("part"), "query_id", "key", (idf * F.col("qtf")).alias("gain"))
    weighted = scratch.keep(weighted.repartition("part").sortWithinPartitions("part", "query_id", "key"), "weighted")
    mean = n_words / max(n_docs, 1)

    lead = scratch.keep(index.where("lead").select("blob"), "lead")
    best = None
    per_query = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")

    def top(hits: DataFrame) -> DataFrame:
        return scratch.keep(hits.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k), "top")

    for part in range(blocks):  # each block of queries meets all shards; its size is bounded by QUERY_TERMS
        rows = weighted.where(F.col("part") == part).select("query_id", "key", "gain").toArrow()
        some = Queries(*(rows.column(c).to_numpy() for c in ("query_id", "key", "gain")))
        # the lead shards first: their k-th best scores are the thresholds that all tasks of the others begin with; a task
        # carries its thresholds from one shard to the next
        sent = spark.sparkContext.broadcast((some, None))
        first = top(lead.mapInArrow(lambda it, sent=sent: search_shards(it, sent.value[0], mean, k), HITS))
        sent.unpersist()
        last = first.where(F.col("rank") == k).select("query_id", "score").toArrow()
        thetas = np.zeros(len(some.ids))
        order = np.argsort(some.ids)
        thetas[order[np.searchsorted(some.ids[order], last.column("query_id").to_numpy())]] = last.column("score").to_numpy() * (1 - 1e-12)
        sent = spark.sparkContext.broadcast((some, thetas))
        rest = index.where("not lead").select("blob").mapInArrow(lambda it, sent=sent: search_shards(it, sent.value[0], mean, k, sent.value[1]), HITS)
        found = top(first.select("query_id", "doc_id", "score").unionAll(rest))
        sent.unpersist()
        best = found if best is None else best.unionAll(found)
    return best.select("query_id", "rank", "doc_id", "score")


def search_by_documents(spark: SparkSession, documents: DataFrame, by: int = BY, k: int = K) -> DataFrame:
    """Every document whose id is divisible by ``by`` is a query with its whole text, against all documents."""
    return search(spark, documents, documents.where(F.col("doc_id") % by == 0).select(F.col("doc_id").alias("query_id"), "text"), k)
