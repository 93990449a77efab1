"""Importance resampling towards a target distribution, over hashed word runs.

A 256-byte table turns the UTF-8 bytes of a text into lower-case words and spaces
(digits, ASCII letters and every byte outside ASCII belong to words), ``bytes.split``
cuts the words out, and a run of words is hashed without being built: the CRC-32 of
``a b`` is that of `` b`` started at the CRC-32 of ``a``. Counters add up the hashes
of a batch, then the buckets of a task; Spark adds up the tasks. A bucket's gain is
the logarithm of how much more often the target has it than the source, a text's
weight the sum of its gains, and its score the weight plus a Gumbel number drawn from
its key: the highest scores are a draw without replacement in proportion to the
exponential of the weights (in thousandths).

Texts are read twice (counts, weights) and never shuffled. What is collected and sent
to the tasks is one gain per bucket, a fixed size. Scores are ranked over ranges of
the whole order, so neither a hot score nor the top of the draw is one task's.

Cases: null and empty texts have no words and weight 0; a null key draws its number
from the word ``null`` and comes after all keys in ties; repeated rows count and are
ranked each; a text of any length is read whole; an empty target or source has no
features, and the gains follow from the added ones; empty tables give an empty table;
other columns do not matter, ``draw`` returns them as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairplay.llm.common import write_table
from fairplay.plans.windows import ordered_index

#: A-Z become a-z; 0-9, a-z and bytes of other characters stay; the rest is blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def runs(raw: bytes | None, longest: int) -> Iterator[list[int]]:
    """The CRC-32 of all runs of 1 word, of 2 words, up to ``longest``."""
    words = (raw or b"").translate(TABLE).split()
    hashes = list(map(crc32, words))
    yield hashes
    for n in range(1, longest):
        hashes = list(map(crc32, [b" " + w for w in words[n:]], hashes))
        yield hashes


def bucket_counts(df: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) over all texts; a task hands on at most a row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            seen: Counter[int] = Counter()
            for raw in batch.column(0).to_pylist():
                for hashes in runs(raw, longest):
                    seen.update(hashes)
            for h, n in seen.items():
                total[h % buckets] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total.keys()), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    found = df.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Gain of every bucket in thousandths, from the counts (bucket, n) of both."""
    sides = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = source.sparkSession.range(buckets).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    both = write_table(sides.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    whole = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t")).first()
    ratio = ((F.col("t") + 1.0) * F.lit(whole["all_s"] + buckets)) / ((F.col("s") + 1.0) * F.lit(whole["all_t"] + buckets))
    out = np.zeros(buckets, np.int64)
    for bucket, gain in both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long")).collect():  # a row per bucket
        out[bucket] = gain
    return out


def weighed(df: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = 1,
            row: Column | None = None) -> DataFrame:
    """(row, key, n_words, n_features, weight) of every row; ``row`` is unique (its own number, if none is given)."""
    sent = df.sparkSession.sparkContext.broadcast(table)  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for raw in batch.column(2).to_pylist():
                lists = list(runs(raw, longest))
                features = np.array([h for x in lists for h in x] if longest > 1 else lists[0], np.int64)
                n_words.append(len(lists[0]))
                n_features.append(len(features))
                weights.append(int(gain[features % len(gain)].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights))],
                names=["row", key, "n_words", "n_features", "weight"])

    slim = df.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col(key), F.col(text).cast("binary").alias("t"))
    return slim.mapInArrow(run, f"row long, {key} {dict(df.dtypes)[key]}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """A Gumbel number in thousandths, from the key alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20,
             row: Column | None = None) -> DataFrame:
    """(row, key, n_words, n_features, weight, score, rank) of every row; undrawn rows have no rank."""
    table = gains(bucket_counts(df, text, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    rows = write_table(weighed(df, table, key, text, longest, row).withColumn("score", F.col("weight") + gumbel(F.col(key), seed)), "weights")
    fit = rows.filter(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("row").asc()]
    ranked = ordered_index(fit, [], order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def draw(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The drawn rows of ``df``, in its columns."""
    rows = write_table(df.withColumn("__row", F.monotonically_increasing_id()), "pool")
    ranked = resample(rows, target, key, text, row=F.col("__row"), **how)
    return rows.join(ranked.filter("rank is not null").select(F.col("row").alias("__row")), "__row", "left_semi").select(*df.columns)
