"""Join helpers: size-checked broadcast and key-salted aggregation.

A broadcast hint is only given when the optimizer's size estimate of the
side is known and below the limit; otherwise the join is left to the
planner (sort-merge, re-planned at runtime by AQE, which converts to a
broadcast join itself when the measured shuffle output is small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (None if unknown)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size if isinstance(size, int) else str(size))
    except Exception:  # pragma: no cover - e.g. Spark Connect
        return None


def broadcast_limit(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        configured = int(str(conf).lower().replace("b", ""))
    except ValueError:
        configured = 10485760
    return max(configured, 0)


def bounded_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``broadcast(df)`` only if its estimated size is below ``max_bytes``."""
    limit = broadcast_limit(df) if max_bytes is None else max_bytes
    size = estimated_bytes(df)
    if size is not None and 0 <= size <= limit:
        return F.broadcast(df)
    return df


def counted_broadcast(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``broadcast(df)`` only if its counted rows fit the limit (for filtered sides, whose
    estimate is the size of the unfiltered table)."""
    return F.broadcast(df) if rows * row_bytes <= broadcast_limit(df) else df


def salt_column(n_salts: int, *seed_cols: str):
    """Deterministic salt in [0, n_salts) from row columns (repeatable on retry)."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in seed_cols]), F.lit(n_salts))
