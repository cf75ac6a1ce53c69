"""Line dedup (operator 1): maximal repeated runs of lines by a suffix array over line ids, native.

The corpus is one sequence of line ids, documents in order of id, a separator after each. Prefix doubling ranks all
suffixes by their first 1, 2, 4, ... lines: the pair of ranks at ``p`` and ``p + 2^k`` orders twice the length, and a
range-partitioned sort of the distinct pairs gives the new ranks. A suffix whose rank is unique is placed for good and
leaves, so each round works only on what still repeats. Positions of the same rank are an interval of the suffix array
with a longest common prefix of at least 2^k.

The intervals are then walked from the longest step to the shortest: at each, a position that shares the next 2^k lines
with a smaller position of its interval goes to that inner interval, and the smallest one stays behind as the outer
interval's representative. What a position ends with is the longest run that starts there and has an earlier copy. Runs
that no run of the line before contains are maximal; those of at least ``min_words`` words are deleted, the first copy
stays. Every step is a join on a position or a map-side combined aggregate: no interval is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Scratch, broadcast_below, pieces

MIN_WORDS = 50
MAX_LEVELS = 40


def sequence(scratch: Scratch, documents: DataFrame) -> DataFrame:
    """(p, d, h, line, id, words): every line with its position; positions of consecutive lines are consecutive, and a
    gap follows each document. Rows of the same id and text are one document."""
    lines = F.split(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), "\n")  # the last piece stands for the separator
    raw = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("d"),
        F.xxhash64("text").alias("h"),
        F.size(lines).alias("n"),
        F.posexplode(lines).alias("line", "s"),
    ).select("d", "h", "line", F.when(F.col("line") < F.col("n") - 1, F.unhex(F.md5("s"))).alias("id"), F.size(pieces(F.col("s"), SPACE)).alias("words"))
    raw = scratch.keep(raw.dropDuplicates(["d", "h", "line"]), "raw")
    placed = raw.repartitionByRange("d", "h").sortWithinPartitions("d", "h", "line").withColumn("p", F.monotonically_increasing_id())
    placed = scratch.keep(placed, "lines")
    scratch.drop(raw)
    return placed.where("id is not null")


def _ranks(scratch: Scratch, keys: DataFrame, by: list[str]) -> DataFrame:
    """The repeated keys in order, with a rising rank ``r``."""
    return scratch.keep(keys.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").orderBy(*by).select(*by, F.monotonically_increasing_id().alias("r")), "ranks")


def doubling(scratch: Scratch, lines: DataFrame) -> list[DataFrame]:
    """Level k: (p, r) for the positions whose first 2^k lines occur elsewhere too; r orders those lines."""
    first = lines.select("p", "id")
    ranks = _ranks(scratch, first, ["id"])
    levels = [scratch.keep(first.join(ranks, "id").select("p", "r"), "level")]
    scratch.drop(ranks)
    for k in range(MAX_LEVELS):
        cur = levels[-1]
        nxt = cur.select((F.col("p") - (1 << k)).alias("p"), F.col("r").alias("b"))
        pairs = scratch.keep(cur.select("p", F.col("r").alias("a")).join(nxt, "p"), "pairs")
        ranks = _ranks(scratch, pairs, ["a", "b"])
        new = scratch.keep(pairs.join(ranks, ["a", "b"]).select("p", "r"), "level")
        scratch.drop(pairs, ranks)
        if new.isEmpty():
            return levels
        levels.append(new)
    raise RuntimeError(f"runs of more than 2^{MAX_LEVELS} lines")


def longest_earlier(scratch: Scratch, levels: list[DataFrame]) -> DataFrame:
    """(p, l): the longest run of lines from p that has a copy at a smaller position; only where there is one.

    ``own`` holds each position's interval, named by its smallest position ``c`` and its depth ``l``; ``inner`` the
    intervals themselves, whose smallest position stands for them.
    """
    own = levels[0].select("p", F.lit(-1).cast("long").alias("c"), F.lit(0).cast("long").alias("l"))
    inner: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        rows = own.select("p", "c", "l", F.lit(True).alias("mine"))
        if inner is not None:
            rows = rows.unionAll(inner.select(F.col("c").alias("p"), "c", "l", F.lit(False).alias("mine")))
        step = levels[k].select(F.col("p").alias("at"), "r")
        ahead = scratch.keep(rows.join(step, F.col("p") + F.col("l") == F.col("at")).select("p", "c", "l", "mine", "r"), "ahead")
        shared = ahead.groupBy("c", "l", "r").agg(F.min("p").alias("m"), F.count("*").alias("n")).where("n > 1").select("c", "l", "r", "m")
        shared = scratch.keep(shared, "shared")
        moved = ahead.where("mine").join(shared, ["c", "l", "r"]).where("p > m").select("p", F.col("m").alias("c2"), (F.col("l") + (1 << k)).alias("l2"))
        new_own = scratch.keep(own.join(moved, "p", "left").select("p", F.coalesce("c2", "c").alias("c"), F.coalesce("l2", "l").alias("l")), "own")
        new = shared.select(F.col("m").alias("c"), (F.col("l") + (1 << k)).alias("l"))
        new_inner = scratch.keep(new if inner is None else inner.unionAll(new), "inner")
        scratch.drop(ahead, shared, own, *([] if inner is None else [inner]))
        own, inner = new_own, new_inner
    return own.where("l > 0").select("p", "l")


def removed_lines(spark: SparkSession, documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, h, line, p): the lines inside later copies of maximal repeated runs of at least ``min_words`` words."""
    scratch = Scratch(spark, "lines")
    lines = sequence(scratch, documents)
    levels = doubling(scratch, lines)
    runs = longest_earlier(scratch, levels)
    scratch.drop(*levels[1:])
    before = runs.select((F.col("p") + 1).alias("p"), F.col("l").alias("l0"))
    maximal = runs.join(before, "p", "left").where("l > coalesce(l0, 0) - 1").select("p", "l")
    inside = maximal.select("p", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("l") - 1)).alias("q"))
    inside = scratch.keep(inside.join(lines.select(F.col("p").alias("q"), "words"), "q"), "inside")
    long = inside.groupBy("p").agg(F.sum("words").alias("w")).where(F.col("w") >= min_words).select("p")
    gone = inside.join(long, "p", "left_semi").select(F.col("q").alias("p")).distinct()
    return scratch.keep(lines.join(gone, "p", "left_semi").select("d", "h", "line", "p"), "gone")


def dedup_lines(spark: SparkSession, documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document row: doc_id, n_lines, n_removed, text (the lines that stay, joined by a line feed).

    The earliest copy of a run, by (doc_id, line), stays. A null text is an empty one, and that is one empty line. A null
    id comes before all others. Rows of the same id and text are one document: each gets its result; rows of the same id
    and other texts are documents of their own, ordered by a digest of the text. Extra columns are ignored; no documents:
    no rows.
    """
    gone = removed_lines(spark, documents, min_words)
    island = F.col("p") - F.row_number().over(W.partitionBy("d", "h").orderBy("p"))
    spans = (
        gone.withColumn("g", island)
        .groupBy("d", "h", "g")
        .agg(F.min("line").alias("a"), F.max("line").alias("b"))
        .groupBy("d", "h")
        .agg(F.collect_list(F.struct("a", "b")).alias("cut"), F.sum(F.col("b") - F.col("a") + 1).alias("n_removed"))
    )
    spans = Scratch(spark, "line-cuts").keep(spans, "spans")
    n_bytes = spans.agg(F.coalesce(F.sum(F.size("cut") * 8 + 48), F.lit(0))).first()[0]
    lines = F.split("s", "\n")
    kept = F.filter(F.col("lines"), lambda _, i: ~F.exists(F.col("cut"), lambda c: (c["a"] <= i) & (i <= c["b"])))
    docs = documents.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("d"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("s")
    )
    return (
        docs.join(broadcast_below(spans, n_bytes), ["d", "h"], "left")
        .select("doc_id", "s", lines.alias("lines"), "cut", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))
        .select("doc_id", F.size("lines").cast("long").alias("n_lines"), "n_removed", F.when(F.col("cut").isNull(), F.col("s")).otherwise(F.array_join(kept, "\n")).alias("text"))
    )


ORACLE = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS i, unnest(ls) AS line FROM s),
l AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM n),
m AS (SELECT a.doc_id, a.i, a.w, b.doc_id AS d0, b.i AS i0 FROM l a JOIN l b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i))),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d0, i - i0 ORDER BY i) AS g FROM m),
t AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, d0, i - i0, g) AS run FROM g),
x AS (SELECT DISTINCT doc_id, i FROM t WHERE run >= {MIN_WORDS}),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(x.i) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE x.i IS NULL) AS text
      FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.i = l.i GROUP BY 1)
SELECT doc_id, n_lines, n_removed, coalesce(text, '') AS text FROM k
"""
