"""Benchmark decontamination (operator 9): a prefix-filtered set join between documents and benchmark items, native.

Items are cut into windows of ``size`` consecutive words (an item of fewer words, but not none, is one window). A
window's tokens are its shingles of ``min(3, words)`` words. One scan of the documents keeps the positions at which any
such shingle occurs and so counts every shingle over the whole corpus. Exact containment needs all of a window's
shingles, so its necessary prefix is one shingle: the rarest (ties: the leftmost). Only documents that hold this one are
candidates; the position of the match fixes where the window would lie, and must leave room for it before and after
(positional and length bounds). Candidates are verified by joining every other shingle of the window, as words and not as
hashes, at its own position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_below, lower_ascii, pieces, unused

#: What separates words: every ASCII character but digits and lower-case letters.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW, SHINGLE = 10, 3
GRAM = ["w0", "w1", "w2"]


def words(text: Column) -> Column:
    return pieces(lower_ascii(text), NOT_WORD)


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, win): the windows of each item, as their words joined by a space; items without a word have none."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (
        w.select("item_id", "w", F.explode(starts).alias("s"))
        .select("item_id", F.concat_ws(" ", F.slice("w", F.col("s"), size)).alias("win"))
        .distinct()
    )


def _same(a: str, b: str) -> Column:
    """The same document row in two frames."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def decontaminate(spark: SparkSession, documents: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside any occurrence of an item's window. A null or wordless text has n_words 0 and no hit.
    Rows are told apart by id and text, so repeated ids are judged row by row and repeated rows alike; extra columns are
    ignored. With no items nothing is hit; ``items_sha256`` is then the digest of the empty string.
    """
    return judge(spark, documents, items, size).drop("h")


def drop_contaminated(spark: SparkSession, documents: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``documents`` without the rows that hold a window of an item; other texts of the same id, or of no id, stay."""
    doc_id, h = unused(documents, "_id", "_h")
    found = judge(spark, documents, items, size).where("contaminated").select(F.col("doc_id").alias(doc_id), F.col("h").alias(h)).distinct()
    return documents.join(found, documents["doc_id"].eqNullSafe(F.col(doc_id)) & (F.xxhash64(documents["doc_id"], documents["text"]) == F.col(h)), "left_anti")


def judge(spark: SparkSession, documents: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """What ``decontaminate`` returns, with ``h``, which tells rows of the same id apart."""
    scratch = Scratch(spark, "decontam")
    owns = scratch.keep(item_windows(items, size), "windows")
    wins = owns.select("win", F.split("win", " ").alias("w")).distinct().withColumn("len", F.size("w"))
    n = F.least(F.col("len"), F.lit(SHINGLE))
    grams = scratch.keep(
        wins.select("win", "len", "w", F.explode(F.sequence(F.lit(0), F.col("len") - n)).alias("off"))
        .select("win", "len", "off", *[F.get("w", F.col("off") + i if i else F.col("off")).alias(GRAM[i]) for i in range(SHINGLE)])
        .withColumns({g: F.when(F.col("len") > i, F.col(g)) for i, g in enumerate(GRAM) if i}),
        "grams",
    )
    n_bytes = grams.agg(F.coalesce(F.sum(F.octet_length("win") + sum(F.coalesce(F.octet_length(g), F.lit(0)) for g in GRAM) + 64), F.lit(0))).first()[0]
    lengths = sorted(r[0] for r in grams.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().collect())  # 1, 2, 3 at most

    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), words(F.col("text")).alias("w"))
    hits = None
    for k in lengths:
        some = broadcast_below(grams.where(F.least("len", F.lit(SHINGLE)) == k).select(*GRAM[:k]).distinct(), n_bytes)
        lead = [F.col("w").alias("w0"), *[F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(1, k)]]
        found = (
            rows.select("doc_id", "h", F.size("w").alias("n_words"), F.arrays_zip(*lead).alias("z"))
            .select("doc_id", "h", "n_words", F.posexplode("z").alias("pos", "g"))
            .select("doc_id", "h", "n_words", "pos", *[F.col(f"g.w{i}").alias(GRAM[i]) for i in range(k)])
            .join(some, GRAM[:k])
            .select("doc_id", "h", "n_words", "pos", *GRAM[:k], *[F.lit(None).cast("string").alias(g) for g in GRAM[k:]])
        )
        hits = found if hits is None else hits.unionAll(found)
    if hits is None:
        hits = rows.select("doc_id", "h", F.size("w").alias("n_words"), F.lit(0).alias("pos"), *[F.lit("").alias(g) for g in GRAM]).limit(0)
    hits = scratch.keep(hits.distinct(), "hits")

    gram_is = lambda a, b: (F.col(f"{a}.w0") == F.col(f"{b}.w0")) & F.col(f"{a}.w1").eqNullSafe(F.col(f"{b}.w1")) & F.col(f"{a}.w2").eqNullSafe(F.col(f"{b}.w2"))
    seen = hits.groupBy(*GRAM).agg(F.count("*").alias("n"))
    anchors = (
        grams.alias("g")
        .join(broadcast_below(seen, n_bytes).alias("s"), gram_is("g", "s"))
        .groupBy("g.win")
        .agg(F.min(F.struct("n", "off", "g.len", "g.w0", "g.w1", "g.w2")).alias("a"), F.count("*").alias("n_seen"))
        .where(F.col("n_seen") == F.col("a.len") - F.least(F.col("a.len"), F.lit(SHINGLE)) + 1)  # a shingle that no document has rules its windows out
        .select("win", "a.off", "a.len", "a.w0", "a.w1", "a.w2")
    )
    anchors = scratch.keep(anchors, "anchors")
    start = F.col("h.pos") - F.col("a.off")
    candidates = (
        hits.alias("h")
        .join(broadcast_below(anchors, n_bytes).alias("a"), gram_is("h", "a"))
        .where((start >= 0) & (start + F.col("a.len") <= F.col("h.n_words")))
        .select("h.doc_id", "h.h", start.alias("start"), "a.win", "a.len")
    )
    verified = (
        candidates.alias("c")
        .join(broadcast_below(grams, n_bytes).alias("g"), "win")
        .select("c.doc_id", "c.h", "c.start", "win", "c.len", (F.col("c.start") + F.col("g.off")).alias("pos"), "g.w0", "g.w1", "g.w2")
        .alias("c")
        .join(hits.alias("h"), _same("c", "h") & (F.col("c.pos") == F.col("h.pos")) & gram_is("c", "h"))
        .groupBy("c.doc_id", "c.h", "c.start", "c.win", "c.len")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == F.col("len") - F.least(F.col("len"), F.lit(SHINGLE)) + 1)
        .select("doc_id", "h", "start", "win", "len")
    )
    verified = scratch.keep(verified, "verified")
    covered = (
        verified.select("doc_id", "h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"))
        .distinct()
        .groupBy("doc_id", "h")
        .agg(F.count("*").alias("n_hit"))
    )
    of_items = (
        verified.select("doc_id", "h", "win")
        .distinct()
        .join(broadcast_below(owns, n_bytes), "win")
        .select("doc_id", "h", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("doc_id", "h")
        .agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("items"))
    )
    found = covered.alias("c").join(of_items.alias("i"), _same("c", "i")).select("c.doc_id", "c.h", "n_hit", "n_items", "items")
    zero = F.lit(0).cast("long")
    return (
        rows.select("doc_id", "h", F.size("w").cast("long").alias("n_words"))
        .alias("d")
        .join(found.alias("f"), _same("d", "f"), "left")
        .select(
            "d.doc_id",
            "d.h",
            "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.coalesce("n_items", zero).alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        )
    )


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS win, least(len(w), {WINDOW}) AS n FROM s),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
m AS (SELECT doc_id, p, item_id, win.n FROM p JOIN win ON win.win = array_to_string(w[p:p + p.n - 1], ' ') AND win.n = p.n),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
