"""Filters and joins across one-to-many relations.

A predicate on the many side of a relation is *existential*: it keeps parents with at least one matching
child and never multiplies them (S12). Semi and anti joins carry no payload columns and de-duplicate by
construction; Catalyst plans them as hash or sort-merge joins and AQE broadcasts a small side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(child: DataFrame, child_key: str | Sequence[str], cond: Column | None) -> DataFrame:
    ks = [child_key] if isinstance(child_key, str) else list(child_key)
    c = child if cond is None else child.filter(cond)
    not_null = None
    for k in ks:
        x = F.col(k).isNotNull()
        not_null = x if not_null is None else not_null & x
    return c.select(*ks).where(not_null)


def _on(parent_key: str | Sequence[str], child_key: str | Sequence[str]) -> tuple[list[str], list[str]]:
    pk = [parent_key] if isinstance(parent_key, str) else list(parent_key)
    ck = [child_key] if isinstance(child_key, str) else list(child_key)
    return pk, ck


def _cond(pk: list[str], rk: list[str]) -> Column:
    cond = None
    for a, b in zip(pk, rk):
        c = F.col(a) == F.col(b)
        cond = c if cond is None else cond & c
    return cond


def where_exists(parent: DataFrame, parent_key, child: DataFrame, child_key, cond: Column | None = None) -> DataFrame:
    """Parents with at least one child satisfying ``cond`` (``left_semi``)."""
    pk, ck = _on(parent_key, child_key)
    keys = _keys(child, ck, cond).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(ck)]).distinct()  # combined before the shuffle
    return parent.join(keys, _cond(pk, [f"__k{i}" for i in range(len(ck))]), "left_semi")


def where_none(parent: DataFrame, parent_key, child: DataFrame, child_key, cond: Column | None = None) -> DataFrame:
    """C11: parents with no (matching) child (``left_anti``). NULL child keys never match, unlike ``NOT IN``."""
    pk, ck = _on(parent_key, child_key)
    keys = _keys(child, ck, cond).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(ck)]).distinct()
    return parent.join(keys, _cond(pk, [f"__k{i}" for i in range(len(ck))]), "left_anti")


def exists_flag(parent: DataFrame, parent_key, child: DataFrame, child_key, cond: Column | None, name: str) -> DataFrame:
    """A boolean column: does the parent have a child satisfying ``cond``? (left join to distinct keys)."""
    pk, ck = _on(parent_key, child_key)
    keys = _keys(child, ck, cond).distinct().select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(ck)], F.lit(True).alias(name))
    out = parent.join(keys, _cond(pk, [f"__k{i}" for i in range(len(ck))]), "left")
    return out.drop(*[f"__k{i}" for i in range(len(ck))]).withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def where_any(parent: DataFrame, local: Column, parent_key, child: DataFrame, child_key, cond: Column | None) -> DataFrame:
    """``local OR exists(child where cond)``, each parent at most once."""
    flagged = exists_flag(parent, parent_key, child, child_key, cond, "__has")
    return flagged.filter(local | F.col("__has")).drop("__has")


def via_bridge(
    parent: DataFrame,
    parent_key: str,
    bridge: DataFrame,
    bridge_parent: str,
    bridge_target: str,
    target: DataFrame,
    target_key: str,
    target_cond: Column,
) -> DataFrame:
    """Parents linked through a many-to-many bridge to at least one target satisfying the condition."""
    t = target.filter(target_cond).select(F.col(target_key).alias("__t"))
    linked = bridge.join(t, F.col(bridge_target) == F.col("__t"), "left_semi")
    return where_exists(parent, parent_key, linked, bridge_parent)


def root_left(root: DataFrame, root_key: str, child: DataFrame, child_key: str, child_cond: Column | None = None) -> DataFrame:
    """Every root row kept; the child's predicate goes into the child before the left join."""
    c = child if child_cond is None else child.filter(child_cond)
    return root.join(c, F.col(root_key) == F.col(child_key), "left")


def count_children(
    root: DataFrame, root_key: str, child: DataFrame, child_key: str, name: str, child_cond: Column | None = None
) -> DataFrame:
    """Every root row with its number of (matching) children, 0 when it has none.

    The children are counted per key first (pre-aggregated), so the join is 1:1 and never fans out.
    """
    c = child if child_cond is None else child.filter(child_cond)
    per = c.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("__ck")).agg(F.count(F.lit(1)).alias(name))
    out = root.join(per, F.col(root_key) == F.col("__ck"), "left").drop("__ck")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def flag_member(df: DataFrame, key: str, members: DataFrame, member_key: str, name: str, yes, no) -> DataFrame:
    """Label each row by membership of its key in ``members`` (left join to distinct keys)."""
    flagged = exists_flag(df, key, members, member_key, None, "__m")
    return flagged.withColumn(name, F.when(F.col("__m"), F.lit(yes)).otherwise(F.lit(no))).drop("__m")
