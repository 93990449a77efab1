"""Exact dedup by an extendible-hash index on shared files.

A text's key is the 64-bit hash of the text without its white space. The index is a
directory over the leading bits of the key and one bucket of postings per directory
entry: a bucket with more than ``capacity`` distinct keys is split by the next bit, and
the directory doubles where a split needs a bit more than it has (only buckets that
are too full are counted again, so a turn costs what they hold). Several slots of the
directory may lead to one bucket. Bucket numbers follow the key, so a task that writes
the index owns a range of keys, and its files hold that range in order.

Copies do not fill a bucket: a posting is a key with its number of rows and the row
that stays, added up before the shuffle. Equal keys are no proof of equal texts: the
texts behind each key are compared byte by byte (as grouping keys: a task hands on each
distinct text once), and where a key has several, they form a chain, each with a link of
its own, in the order of their bytes. Rows are then known by key and link.

Main path: DataFrame functions only. What is joined to all rows is slim; a key that a
third of the rows share is one posting, and the rows' join to it can be split.

Cases: null text is empty, and equal to every text of white space alone; of equal texts
the row with the most code points stays, then the smallest key (null last); of rows equal
in these too, exactly one; long texts are compared whole; an empty table gives an empty
table; other columns do not matter, ``keep`` returns them as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fairplay.llm.common import text_or_empty, write_table
from fairplay.plans.joins import bounded_broadcast, broadcast_limit
from fairplay.session import cut_lineage

BLANK = r"[\x20\x09-\x0D]+"
#: Distinct keys in a bucket before it is split.
CAPACITY = 20_000


def normal(text: str) -> Column:
    return F.regexp_replace(text_or_empty(text), BLANK, "")


def hashed(norm: str, bits: int = 64) -> Column:
    """The leading ``bits`` of the key, in place. Fewer bits make chains, never other results."""
    h = F.xxhash64(norm)
    return h if bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def prefix(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Distinct keys (h) -> (slot, bucket, depth, n): the slots of the doubled directory.

    ``bucket`` is the first slot of its range, so buckets are numbered in key order. A bucket
    whose keys are one key is not split. Every row of the result carries ``global_depth``.
    """
    depth = max(0, math.ceil(math.log2(max(1, keys.count()) / capacity)))
    settled, open_keys = [], keys.select("h")
    while True:
        counts = cut_lineage(open_keys.groupBy(prefix(depth).alias("prefix")).agg(
            F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high")))
        overfull = (F.col("n") > capacity) & (F.col("low") != F.col("high"))
        settled.append(counts.filter(~overfull).select(F.lit(depth).alias("depth"), "prefix", "n"))
        full = counts.filter(overfull).select(F.col("prefix").alias("__p"))
        if full.isEmpty():
            break
        open_keys = open_keys.join(bounded_broadcast(full), prefix(depth) == F.col("__p")).select("h")
        depth += 1
    buckets = settled[0]
    for x in settled[1:]:
        buckets = buckets.unionByName(x)
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    slots = F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - depth) - 1")))
    return write_table(buckets.select(slots.alias("slot"), first.alias("bucket"), "depth", "n", F.lit(depth).alias("global_depth")), "directory")


def chains(texts: DataFrame, keys: DataFrame) -> DataFrame | None:
    """(h, norm, link) of the keys that several texts share; None if there are none.

    ``texts``: (h, norm) of all rows; ``keys``: (h, n). Texts of keys in one row need no
    comparison; they are left out where the other keys are few enough to be sent to all tasks.
    """
    shared = write_table(keys.filter("n > 1").select(F.col("h").alias("__h")), "shared-keys")
    if shared.count() * 16 <= broadcast_limit(shared):
        texts = texts.join(F.broadcast(shared), texts["h"] == shared["__h"], "left_semi")
    distinct = texts.distinct()
    crowded = write_table(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "crowded-keys")
    if crowded.isEmpty():
        return None
    in_order = W.partitionBy("h").orderBy("norm")
    return write_table(distinct.join(bounded_broadcast(crowded), "h").withColumn("link", F.row_number().over(in_order) - 1), "chains")


class Index:
    """The index of a table: ``entries`` (a slim row per row), ``slots`` and ``postings``."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bits: int = 64,
                 row: Column | None = None):
        """``row``: a unique number of each row, its own if none is given."""
        told = df.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col(key).alias("key"),
                         F.length(text_or_empty(text)).alias("size"), normal(text).alias("norm"))
        told = told.withColumn("h", hashed("norm", bits))
        slim = ["row", "key", "size", "h", F.unhex(F.sha2("norm", 256)).alias("sha")]
        entries = write_table(told.select(*slim, F.lit(0).alias("link")), "entries")
        keys = cut_lineage(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
        collided = chains(told.select("h", "norm"), keys)
        if collided is not None:
            links = collided.select(F.col("h").alias("__h"), F.col("norm").alias("__norm"), F.col("link").alias("__link"))
            linked = told.join(bounded_broadcast(links), (F.col("h") == F.col("__h")) & (F.col("norm") == F.col("__norm")), "left")
            entries = write_table(linked.select(*slim, F.coalesce("__link", F.lit(0)).alias("link")), "entries")
        self.entries, self.slots = entries, directory(keys, capacity)
        self.postings = self._written()

    def _written(self) -> DataFrame:
        """(bucket, h, link, n, keep): the bucket files, each task's a range of keys in order."""
        depth = self.slots.agg(F.max("global_depth")).first()[0] or 0
        best = F.min(F.struct((-F.col("size")).alias("less"), F.col("key").isNull().alias("none"), "key", "row"))
        added = self.entries.groupBy("h", "link").agg(F.count(F.lit(1)).alias("n"), best.alias("keep"))
        placed = added.withColumn("slot", prefix(depth)).join(bounded_broadcast(self.slots.select("slot", "bucket")), "slot").drop("slot")
        parts = int(self.entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        owned = placed.repartitionByRange(parts, "bucket", "h").sortWithinPartitions("bucket", "h", "link")
        return write_table(owned.select("bucket", "h", "link", "n", "keep"), "buckets")

    def classes(self) -> DataFrame:
        """(row, key, size, sha, keep_key, keep_row, n) of every row."""
        told = self.postings.select(F.col("h").alias("__h"), F.col("link").alias("__link"), "n",
                                    F.col("keep.key").alias("keep_key"), F.col("keep.row").alias("keep_row"))
        same = (F.col("h") == F.col("__h")) & (F.col("link") == F.col("__link"))
        return self.entries.join(told, same).select("row", "key", "size", "sha", "keep_key", "keep_row", "n")


def keep(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that stay, in its columns."""
    rows = write_table(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    stay = Index(rows, key, text, row=F.col("__row"), **how).postings.select(F.col("keep.row").alias("__row"))
    return rows.join(stay, "__row", "left_semi").select(*df.columns)
