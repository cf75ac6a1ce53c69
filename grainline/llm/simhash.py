"""SimHash near-dedup (operator 4): 64-bit fingerprints, linked at a few differing bits through pivot distance tables.

The fingerprints are made in Arrow batches (numpy inside the tasks). Equal fingerprints are one node, named by the
smallest document id that has it. To meet, two nodes must agree in ``BANDS - max_bits`` of ``BANDS`` bit bands (at most
``max_bits`` bands can differ), so every node is sent once per choice of bands; that only says which nodes are compared
at all. Within such a block the table of Hamming distances to the reference fingerprints is precomputed, pairs are
discarded as soon as one coordinate differs by more than ``max_bits`` (the triangle inequality), and the survivors are
verified by the exact distance. A block of more than ``BLOCK`` nodes is cut into pieces, and every pair of pieces is a
block of its own, so that no task holds an unbounded group; what a task returns is a spanning forest of the links it
found, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_below, components, local_components, unused

SHINGLE, MAX_BITS, SEED = 3, 3, 42
BANDS, BLOCK, PIVOTS = 6, 2048, 16
SLICE = 200_000  # shingles whose bits are counted at once


def fingerprint(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text over its word n-grams; null, empty or wordless: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    if len(words) <= n:
        spans = [(0, len(joined))]
    else:
        spans = list(zip([0, *ends[: len(words) - n]], [e - 1 for e in ends[n - 1 :]], strict=True))
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(spans), SLICE):
        h = np.array([digest(joined[a:b], seed) for a, b in spans[i : i + SLICE]], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * count > len(spans)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, n: int = SHINGLE, *beside: str) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long; ``beside`` names more columns of longs to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), n) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64()), *[b.column(c) for c in beside]], ["doc_id", "fp", *beside])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "fp", *beside))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *beside).mapInArrow(run, schema)


def band_keys(fp: Column, max_bits: int = MAX_BITS, bands: int = BANDS) -> Column:
    """An array of structs (c, v): the fingerprint under every mask of ``bands - max_bits`` bands."""
    edge = [round(64 * i / bands) for i in range(bands + 1)]
    masks = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(bands)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(bands), bands - max_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    return F.array(*[F.struct(F.lit(i).alias("c"), fp.bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)])


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """The pivots: pseudo-random fingerprints, the same in every run."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64)


def links(block: np.ndarray, fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between rows (positions) of the same block with at most ``max_bits`` differing bits.

    Rows must be sorted by block. Row i meets row i + 1, then row i + 2, ..., all rows at a time.
    """
    pivots = reference_fingerprints()
    table = np.stack([np.bitwise_count(fp ^ p) for p in pivots]).astype(np.int8)
    order = np.lexsort((table[0], block))  # by the first coordinate inside a block
    block, fp, table = block[order], fp[order], table[:, order]
    left, right, held, i = [], [], 0, np.arange(len(fp))
    for step in range(1, len(fp)):
        i = i[i + step < len(fp)]
        i = i[block[i] == block[i + step]]
        i = i[table[0][i + step] - table[0][i] <= max_bits]  # sorted: no later row of the block is nearer
        if not len(i):
            break
        pair = i
        for d in table[1:]:
            pair = pair[np.abs(d[pair] - d[pair + step]) <= max_bits]
        pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + step]) <= max_bits]
        left.append(order[pair])
        right.append(order[pair + step])
        held += len(pair)
        if held > 4_000_000:
            a, b = local_components(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], len(a)
    a, b = local_components(np.concatenate([*left, [0]]).astype(np.int64), np.concatenate([*right, [0]]).astype(np.int64))
    return a[a != b], b[a != b]


def _link_partition(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if t is not None and t.num_rows:
        key, fp, node = (t.column(c).to_numpy() for c in ("key", "fp", "node"))
        a, b = links(key, fp.view(np.uint64), max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


def near_duplicates(spark: SparkSession, documents: DataFrame, n: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Links join fingerprints of at most ``max_bits`` differing bits. Null, empty and wordless texts have fingerprint zero
    and are linked like any other. Repeated ids give repeated rows, each with its own text's fingerprint and component. A
    null id gives a row of its own; it names a component only where no row reachable has an id (null then). No documents:
    no rows. Extra columns are ignored.
    """
    scratch = Scratch(spark, "simhash")
    prints = scratch.keep(fingerprints(documents, n), "prints")
    # Ids can repeat over texts, so a component is found over fingerprints and named by its smallest id afterwards.
    named = labelled(scratch, prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), max_bits)
    first = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_print = named.join(first, "c").select(F.col("fp").alias("p"), "component_id")
    joined = prints.join(of_print, prints["fp"] == F.col("p"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def labelled(scratch: Scratch, nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``nodes``, one row per fingerprint ``fp``, with the label ``c`` of its component: a fingerprint of it."""
    nodes = scratch.keep(nodes, "nodes")
    keys = nodes.select("fp", F.explode(band_keys(F.col("fp"), max_bits)).alias("k")).select("fp", F.xxhash64("k.c", "k.v").alias("key"))
    hot = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("cut"))
    hot = scratch.keep(hot, "hot")
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cut")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    n_hot = hot.count()
    split = None
    if n_hot:
        split = (
            keys.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "key")
            .select("fp", "key", part.alias("i"), other.alias("j"))
            .select("fp", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"))
        )
        keys = keys.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "key", "left_anti").unionByName(split)
    found = (
        keys.select("key", "fp", F.col("fp").alias("node"))
        .repartition("key")
        .mapInArrow(lambda it: _link_partition(it, max_bits), "a long, b long")
    )
    linked = components(found, scratch)  # fingerprints as nodes
    return scratch.keep(nodes.join(linked, nodes["fp"] == linked["node"], "left").select(*nodes.columns, F.coalesce("component", "fp").alias("c")), "named")


def keep_one(spark: SparkSession, documents: DataFrame, n: int = SHINGLE, max_bits: int = MAX_BITS, repeats: bool = True) -> DataFrame:
    """``documents`` without near duplicates: of each component the row that is smallest by id (null last), then text hash.

    Ties go by a hash of all columns. Rows that are equal in every column all stay with ``repeats``; without, one of them.
    """
    scratch = Scratch(spark, "keep_one")
    key = unused(documents, "_h", "_all")
    columns = [documents[c] for c in documents.columns]
    rows = documents.withColumns({key[0]: F.xxhash64("doc_id", "text"), key[1]: F.xxhash64(*columns, *[c.isNull() for c in columns])})
    prints = scratch.keep(fingerprints(rows, n, *key), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", *key, "_n")).alias("_first")
    each = prints.groupBy("fp", "doc_id", *key).agg(F.count("*").alias("_n"))
    named = labelled(scratch, each.groupBy("fp").agg(first), max_bits)
    chosen = scratch.keep(named.groupBy("c").agg(F.min("_first").alias("_first")).select(*[f"_first.{c}" for c in (*key, "_n")]), "chosen")
    if repeats:
        return rows.join(chosen, key, "left_semi").select(*documents.columns)
    kept = rows.join(chosen.where("_n = 1"), key, "left_semi").select(*documents.columns)
    many = chosen.where("_n > 1")
    n_many = many.count()
    if n_many:
        again = rows.join(broadcast_below(many, 32 * n_many), key, "left_semi").dropDuplicates(key)  # combined before the shuffle
        kept = kept.unionByName(again.select(*documents.columns))
    return kept
