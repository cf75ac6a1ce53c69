"""Mixing sources to target weights (operator 3) by Pareto order sampling, native.

A source's target is a share of all words. Its ratio to the source's own size says how many copies of each document are
expected: the whole part is allocated for certain, the rest is the document's inclusion probability ``p``. Documents are
ranked by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and the smallest are taken until the words
the whole copies leave open are filled: a sample of fixed size in words, exact to half a document. ``u`` comes from a
digest of the document's id and text, so reruns and retried tasks agree, and different texts of one id (or of none) are
drawn apart and lie in different cells.

No source is sorted in one task: the logarithm of the ranking value is cut into 4,096 cells three times over; each time
only sums per cell are shuffled, the cell where the target is reached is cut again, and only the documents of the last
such cell (a 2^36th of the value range) are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Scratch, broadcast_below, pieces, unused

WEIGHTS, SHARE, MAX_COPIES, SEED = (3, 1, 2), 1.5, 2, "mix"
CELL_BITS, LEVELS = 12, 3


def n_words(text: Column) -> Column:
    return F.size(pieces(text, SPACE)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """``sizes(source, source_size)`` -> source, source_size, target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all words; a target stops
    at ``cap`` times its source, and what is above is shared anew by weight until none is above. That fixed point is a
    water level: sorted by size per weight, the sources below the level get their cap, the others ``weight * level``.
    There is one row per source here, so the two windows run over the list of sources only.
    """
    at = W.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("w", F.get(ring, (F.row_number().over(at) - 1) % len(weights)))
    by = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    t = t.select(
        "*",
        F.row_number().over(by).alias("k"),
        F.sum("source_size").over(W.partitionBy()).alias("total"),
        F.coalesce(F.sum("source_size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)).alias("w_rest"),
    ).withColumn("open", F.lit(float(share)) * F.col("total") - F.lit(float(cap)) * F.col("below"))
    free = t.where(F.lit(float(cap)) * F.col("source_size") >= F.col("w") * F.col("open") / F.col("w_rest"))
    first = free.agg(F.min(F.struct("k", "open", "w_rest")).alias("f")).first()["f"]  # one row
    capped = F.lit(float(cap)) * F.col("source_size")
    target = capped if first is None else F.when(F.col("k") < first["k"], capped).otherwise(F.col("w") * F.lit(first["open"]) / F.lit(first["w_rest"]))
    return t.select("source", "source_size", target.alias("target"))


def _expected(scratch: Scratch, units: DataFrame, goal: DataFrame, cap: int, n_bytes: int, max_rounds: int = 50) -> DataFrame:
    """Per source the factor ``c`` at which ``min(cap, c * weight)`` copies of each document add up to the target."""
    c = goal.join(
        units.groupBy("source").agg(F.sum(F.col("weight") * F.col("words")).alias("open")), goal["source"].eqNullSafe(units["source"])
    ).select(goal["source"], "target", F.coalesce(F.try_divide("target", "open"), F.lit(0.0)).alias("c"))
    for _ in range(max_rounds):
        full = F.col("u.weight") * F.col("c.c") >= cap
        again = (
            units.alias("u")
            .join(broadcast_below(c, n_bytes).alias("c"), F.col("u.source").eqNullSafe(F.col("c.source")))
            .groupBy("c.source", "target", "c")
            .agg(F.sum(F.when(full, cap * F.col("words")).otherwise(0)).alias("full"), F.sum(F.when(~full, F.col("weight") * F.col("words")).otherwise(0)).alias("open"))
            .select("source", "target", F.col("c").alias("was"), F.coalesce(F.try_divide(F.col("target") - F.col("full"), "open"), F.col("c")).alias("c"))
        )
        again = scratch.keep(again, "factor")
        moved = again.where(F.abs(F.col("c") - F.col("was")) > 1e-12 * F.abs("c")).limit(1).count()
        c = again.select("source", "target", "c")
        if not moved:
            return c
    raise RuntimeError("the expected copies did not settle")


def allocate(
    spark: SparkSession,
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    weight: Column | None = None,
    seed: str = SEED,
) -> DataFrame:
    """Copies of every document in the mix: doc_id, source, h (digest of the text), size, m, source_size, target, copies.

    ``weight`` (positive) makes a document's expected copies proportional to it within its source, up to ``max_copies``.
    Rows with the same id, source and text are one unit of ``m`` rows, taken together; a null id, source or text is a
    value like any other, a null or empty text has size 0. Ties in the ranking go by id, then by digest of the text. No
    documents: no rows. Extra columns are ignored.
    """
    scratch = Scratch(spark, "mix")
    extra = F.lit(1.0) if weight is None else weight.cast("double")
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce("text", F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    units = (
        documents.select("doc_id", "source", F.xxhash64("text").alias("h"), n_words(F.col("text")).alias("size"), extra.alias("weight"), u.alias("u"))
        .groupBy("doc_id", "source", "h", "size")
        .agg(F.count("*").alias("m"), F.max("weight").alias("weight"), F.max("u").alias("u"))
        .withColumn("words", F.col("m") * F.col("size"))
    )
    units = scratch.keep(units, "units")
    goal = scratch.keep(targets(units.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_copies), "goal")
    n_bytes = goal.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.lit(0))).first()[0]
    if weight is None:
        factor = goal.select("*", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("c"))
    else:
        c = _expected(scratch, units, goal.select("source", "target"), max_copies, n_bytes)
        factor = goal.join(c.select(F.col("source").alias("s"), "c"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    e = F.least(F.lit(float(max_copies)), F.col("g.c") * F.col("u.weight"))
    ranked = (
        units.alias("u")
        .join(broadcast_below(factor, n_bytes).alias("g"), F.col("u.source").eqNullSafe(F.col("g.source")))
        .select("u.doc_id", "u.source", "h", "size", "m", "words", "source_size", "target", F.floor(e).cast("long").alias("whole"), (e - F.floor(e)).alias("p"), F.col("u.u").alias("u"))
        .withColumn("q", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("cell", F.floor((F.log("q") + 128) * F.lit(float(1 << 28))).cast("long"))
    )
    ranked = scratch.keep(ranked, "ranked")

    need = ranked.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("words"))).alias("need"))
    state = need.select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    draw = ranked.where("p > 0").select("source", "cell", "words", "doc_id", "h", "q")
    for level in range(LEVELS):
        shift = CELL_BITS * (LEVELS - 1 - level)
        cells = (
            draw.alias("d")
            .join(broadcast_below(state, n_bytes).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.shiftright("d.cell", shift + CELL_BITS) == F.col("s.prefix")))
            .groupBy("s.source", "need", "before", F.shiftright("d.cell", shift).alias("cell"))
            .agg(F.sum("words").alias("words"))
        )
        upto = F.sum("words").over(W.partitionBy("source").orderBy("cell"))
        reached = cells.withColumn("upto", F.col("before") + upto).where("upto > need").groupBy("source", "need").agg(F.min(F.struct("cell", "upto", "words")).alias("x"))
        state = scratch.keep(reached.select("source", "need", F.col("x.cell").alias("prefix"), (F.col("x.upto") - F.col("x.words")).alias("before")), "state")

    in_cell = (
        draw.alias("d")
        .join(broadcast_below(state, n_bytes).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.cell") == F.col("s.prefix")))
        .select("d.source", "d.doc_id", "d.h", "need", "words", (F.col("before") + F.coalesce(F.sum("words").over(W.partitionBy("d.source").orderBy("d.q", F.col("d.doc_id").asc_nulls_last(), "d.h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    )
    taken_there = in_cell.where("2 * before + words <= 2 * need").select("source", "doc_id", "h", F.lit(1).alias("hit"))
    whole_cells = state.select(F.col("source").alias("s_source"), F.col("prefix").alias("s_prefix"), F.lit(1).alias("s_open"))
    out = (
        ranked.join(broadcast_below(whole_cells, n_bytes), F.col("source").eqNullSafe(F.col("s_source")), "left")
        .alias("r")
        .join(taken_there.alias("t"), F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.h") == F.col("t.h")) & F.col("r.source").eqNullSafe(F.col("t.source")), "left")
    )
    sampled = F.when(F.col("p") <= 0, 0).when(F.col("s_open").isNull() | (F.col("cell") < F.col("s_prefix")), 1).otherwise(F.coalesce("hit", F.lit(0)))
    return out.select("r.doc_id", "r.source", "r.h", "size", "m", "source_size", "target", (F.col("whole") + sampled).alias("copies"))


def mix(spark: SparkSession, documents: DataFrame, **kw) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken (words the mix takes), copies."""
    a = allocate(spark, documents, **kw)
    each = a.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies"))


def apply_mix(spark: SparkSession, documents: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: every row of ``documents`` as many times as the mix takes it, with the same columns."""
    doc_id, source, h, key, copies, n = unused(documents, "_id", "_source", "_h", "_key", "_copies", "_n")
    a = allocate(spark, documents, **kw).where("copies > 0").select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), F.col("h").alias(h), F.col("copies").alias(copies))
    d = documents.withColumn(key, F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col(key) == F.col(h)) & F.col("source").eqNullSafe(F.col(source))
    return d.join(a, on).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[documents[c] for c in documents.columns])


ORACLE = f"""
WITH d AS (SELECT doc_id, source, md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, list_value(3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE)[1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w FROM s),
l AS (SELECT *, row_number() OVER o AS k, sum(source_size) OVER () AS total,
             coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest
      FROM n WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
x AS (SELECT *, {SHARE}::DOUBLE * total - 2.0::DOUBLE * below AS open FROM l),
f AS (SELECT k, open, w_rest FROM x WHERE 2.0::DOUBLE * source_size >= w * open / w_rest ORDER BY k LIMIT 1),
t AS (SELECT x.source, x.source_size, CASE WHEN x.k < f.k THEN 2.0::DOUBLE * x.source_size ELSE x.w * f.open / f.w_rest END AS target FROM x, f),
e AS (SELECT d.*, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS c,
             (CAST('0x' || substr(digest, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(c) AS whole, c - floor(c) AS p FROM e),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
r AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS need,
             coalesce(sum(size) OVER (PARTITION BY source, p > 0 ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
a AS (SELECT *, CAST(whole + CASE WHEN p > 0 AND 2 * before + size <= 2 * need THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM a
"""
