"""Broadcast guards: a side is broadcast only behind a size bound, otherwise the join shuffles.

The bound is a *declared* number of rows that does not grow with the data (5 regions, 25 nations, one row
of a scalar aggregate, the months of a calendar range).

Everything else is left to adaptive execution, which re-plans a shuffled join as a broadcast join only
when the runtime size of a side is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest declared row bound we broadcast on its own say-so.
MAX_DECLARED_ROWS = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast ``df`` when its row count has a data-independent bound ``max_rows``."""
    if max_rows is not None and max_rows <= MAX_DECLARED_ROWS:
        return F.broadcast(df)
    return df
