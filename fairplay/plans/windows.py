"""Window patterns that stay parallel when a window key is coarse or skewed.

``ordered_index`` numbers rows 1..n inside each group in a given order
without one task per group: rows are dealt by ranges, range sizes are counted
(a small aggregate), a running sum over the ranges gives each one's offset, and
rows are numbered inside their range only.

``average_rank`` gives pandas-style average ranks (ties share the mean of
their positions) from a (group, value, count) aggregate, again without a
window over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairplay.plans.joins import bounded_broadcast
from fairplay.session import cut_lineage


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def ordered_index(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                  name: str = "idx") -> DataFrame:
    """Add ``name`` = 1-based position of each row inside ``group_cols`` by ``order_cols``.

    ``order_cols`` must make the order total. Rows are dealt by ranges of (group, order),
    as many as the session has shuffle partitions, so a hot group or a hot first key is
    split; the ranges are fixed by a reliable checkpoint and counted, and the offsets are
    one row per range and group in it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *group_cols, *order_cols).withColumn("_b", F.spark_partition_id())
    keyed = cut_lineage(ranged)
    sizes = keyed.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wg = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy())
    wg = wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group_cols, "_b", F.coalesce(F.sum("_n").over(wg), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*group_cols, "_b").orderBy(*order_cols)
    numbered = keyed.withColumn("_rn", F.row_number().over(within))
    named = offsets.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col("_b").alias("_g_b"), "_off")
    same = F.col("_b") == F.col("_g_b")
    for c in group_cols:  # a null group is a group
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = numbered.join(bounded_broadcast(named), same).drop(*[f"_g_{c}" for c in group_cols], "_g_b")
    return joined.withColumn(name, (F.col("_off") + F.col("_rn")).cast("long")).drop("_b", "_rn", "_off")


def trailing_blocks(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], back: int,
                    width: int = 4096):
    """For windows that look back at most ``back`` rows in a group: (rows, window).

    Each group is cut into blocks of ``width`` positions; the last ``back`` rows of a block are
    also given to the next (``_halo`` 1), so a window over the returned spec sees the same rows as
    one over the whole group, and a hot group is many tasks. Keep rows with ``_halo`` 0
    afterwards and drop ``_pos``, ``_block`` and ``_halo``.
    """
    x = ordered_index(df, group_cols, order_cols, name="_pos")
    into_next = F.pmod(F.col("_pos") - 1, F.lit(width)) >= width - back
    x = x.withColumn("_halo", F.explode(F.when(into_next, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    x = x.withColumn("_block", F.floor((F.col("_pos") - 1) / width) + F.col("_halo"))
    return x, Window.partitionBy(*group_cols, "_block").orderBy("_pos")


def average_rank_table(df: DataFrame, group_cols: Sequence[str], value_col: str,
                       ascending: bool = True, name: str = "rank") -> DataFrame:
    """(group, value) -> average rank of that value among the rows of its group.

    Works on the distinct (group, value) counts; join the result back on
    (group, value). Nulls are not ranked (pandas ``rank`` leaves them NaN).
    """
    counts = (df.where(F.col(value_col).isNotNull())
              .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n")))
    order = F.col(value_col).asc() if ascending else F.col(value_col).desc()
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy(order)
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(*group_cols, value_col,
                         (before + (F.col("_n") + 1) / 2.0).alias(name))


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
                    salt_cols: Sequence[str], salts: int = 64, name: str = "rank") -> DataFrame:
    """Rows ranked 1..k inside each group by ``order`` (a total order).

    Two stages so a group holding a third of the rows is still spread out:
    first the top k inside (group, salt) with salt = hash(salt_cols) % salts,
    then the top k among the <= salts x k survivors of each group.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salts))
    x = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    stage1 = x.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return (stage1.withColumn(name, F.row_number().over(w2)).where(F.col(name) <= k)
            .drop("_salt", "_r1"))
