"""Mixing sources to target weights by capped water-filling.

Sources weigh 5, 2, 1, repeating in code-point order of their names (null last).
A budget (``share`` times all sizes) is dealt by weight; a source whose part
exceeds ``max_epochs`` times its size is clamped there and the excess goes to the
others by weight, again and again until no part exceeds its cap (one small
aggregate over the source table per turn; every turn clamps a source or ends).

A source's target is met by whole repetitions of all its documents plus one more
copy of some: its documents are taken in the order of a seeded MD5 of their id
until the remaining words are reached, to within half a document. The order
is cut into 4096 buckets per source, so a source holding a third of all rows is
summed per bucket (map-side) and only the one bucket per source in which the cut
falls is ordered row by row. Reruns agree whatever the partitioning.

Cases: null text has size 0 and is taken 0 words; a null source is a source of its
own; repeated rows count each; an empty table gives an empty table; a source
without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairplay.session import cut_lineage

WEIGHTS = (5, 2, 1)
BUCKET_DIGITS = 3


def source_targets(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, __n, source_size) -> with weight and target. One row per source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    # One row per source after aggregation: the only window without a partition.
    s = sources.withColumn("__i", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    s = cut_lineage(
        s.withColumn("weight", F.array(*[F.lit(w) for w in weights])[F.col("__i")]).drop("__i")
        .withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs))))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, 0.0
    clamped = F.lit(False)
    while True:
        caps, weight, n = s.filter(clamped).agg(F.sum("__cap")).first()[0] or 0.0, *s.filter(~clamped).agg(
            F.sum("weight"), F.count(F.lit(1))).first()
        if not n:
            break
        level = (budget - caps) / weight
        above = F.col("weight") * F.lit(level) > F.col("__cap")
        if not s.filter(~clamped & above).limit(1).count():
            break
        clamped = above  # the level only rises: what was clamped stays so
    return s.withColumn("target", F.when(clamped, F.col("__cap")).otherwise(F.lit(level) * F.col("weight"))).drop("__cap")


def repetitions(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size",
                share: float = 1.5, max_epochs: float = 2.0, seed: int = 1, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (slim: it is written once and read three times) with ``source_size``,
    ``target`` and ``copies``. ``ties``: columns that order rows of equal key and size."""
    rows = cut_lineage(
        df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary")))
        .withColumn("__bucket", F.substring("__h", 1, BUCKET_DIGITS))
        .withColumn("__s", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))))
    buckets = cut_lineage(rows.groupBy(F.col("__s"), F.col("__bucket")).agg(
        F.first(source).alias("source"), F.sum(size).alias("__sum")))
    targets = source_targets(buckets.groupBy("__s").agg(F.first("source").alias("source"), F.sum("__sum").alias("source_size")),
                             share, max_epochs).drop("source", "weight")
    running = W.partitionBy("__s").orderBy("__bucket")
    cut = (buckets.drop("source").withColumn("__end", F.sum("__sum").over(running)).join(targets, "__s")
           .withColumn("__whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
           .withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
           .withColumn("__start", F.col("__end") - F.col("__sum"))
           .withColumn("__state", F.when(F.col("__end") <= F.col("__rest"), 1).when(F.col("__start") >= F.col("__rest"), 0).otherwise(2)))
    joined = rows.join(cut, ["__s", "__bucket"])
    settled = joined.filter("__state < 2").withColumn("__extra", F.col("__state").cast("long"))
    inside = W.partitionBy("__s", "__bucket").orderBy("__h", F.col(key).asc_nulls_first(), size, *ties)
    split = (joined.filter("__state = 2")
             .withColumn("__cum", F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, 0)))
             .withColumn("__extra", (F.col("__start") + F.col("__cum") - F.col(size) / 2 <= F.col("__rest")).cast("long"))
             .drop("__cum"))
    return (settled.unionByName(split).withColumn("copies", F.col("__whole") + F.col("__extra"))
            .drop("__s", "__bucket", "__h", "__sum", "__end", "__start", "__whole", "__rest", "__state", "__extra"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, in ``docs``' columns.

    The decision is the row's own, whatever its key: rows of a repeated or null key are
    numbered in a written copy of ``docs``, and each follows its source's target.
    """
    from fairplay.llm.common import n_words, write_table

    rows = write_table(docs.withColumn("__row", F.monotonically_increasing_id()), "mix")
    slim = rows.select("__row", F.col(key).alias("__key"), F.col(source).alias("__source"), n_words(text).alias("__size"),
                       F.xxhash64(text).alias("__tie"))
    plan = (repetitions(slim, "__key", "__source", "__size", ties=("__tie",), **how)
            .select("__row", F.col("copies").cast("int").alias("__copies")).filter("__copies > 0"))
    taken = rows.join(plan, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select(*[taken[c] for c in docs.columns])
