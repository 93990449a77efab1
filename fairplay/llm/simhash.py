"""SimHash near-dedup: fingerprints, pigeonring filtering, components.

A fingerprint has 64 bits over the word shingles of a text. Two fingerprints link
at ``max_bits`` (t) or fewer differing bits. The 64 bits are cut into m segments on
a ring. If the segment differences sum to at most t, there is a segment from which
every chain of l consecutive segments differs in at most l * t / m bits; so the
first segments of that chain, as long as l * t / m < 1, are equal. These equal
segments are the join key, the budgets of the longer chains prune what the key
brings together, and only then the full distance is checked. With m = 8 and t = 2
the key is 3 segments (24 bits), and a chain of 7 may differ in 1 bit.

Only distinct fingerprints are compared (a third of all rows may share one). A
bucket of at most ``pair_limit`` fingerprints is joined with itself; a larger one
is resolved exactly another way: each fingerprint is written with every choice of
up to t // 2 bits outside the key flipped, and those that meet in the same value
differ in at most t bits, which links them to the smallest of them. No bucket
emits its square and nothing is dropped. (t must be even there; odd t pairs all.)

Cases: null and empty texts have fingerprint zero and link like any other; fewer
words than a shingle make one shingle; repeated rows and ties are kept, each row
gets its component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairplay.llm.common import carried
from fairplay.operators.components import components
from fairplay.session import cut_lineage

SEED = 42
BITS = 64


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = words_per_shingle
    parts = zip(*(words[i:] for i in range(k)), strict=False) if len(words) >= k else [words]
    digest, join = xxhash.xxh64_digest, b" ".join
    hashes = b"".join([digest(join(p), SEED) for p in parts])
    n = len(hashes) // 8
    ones = np.zeros(BITS, np.int64)
    table = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for i in range(0, n, 65536):
        ones += np.unpackbits(table[i:i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3, *more: str) -> DataFrame:
    """(key, fp long, more columns) of every row."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["fp"] = [fingerprint(t, words_per_shingle) for t in b["t"]]
            yield b.drop(columns="t")

    slim = df.select(F.col(key).cast(carried(types[key])).alias("k"), *more, F.col(text).alias("t"))
    out = slim.mapInPandas(run, ", ".join([f"k {carried(types[key])}", *(f"{c} {types[c]}" for c in more), "fp long"]))
    return out.select(F.col("k").cast(types[key]).alias(key), *more, "fp")


def links(fps: DataFrame, max_bits: int = 2, segments: int = 8, pair_limit: int = 64) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v); every pair in reach is linked,
    directly or (in large buckets) through fingerprints in reach of both."""
    width, t = BITS // segments, max_bits
    equal = max((n for n in range(1, segments) if n * t < segments), default=0)
    if not equal or BITS % segments:
        raise ValueError("segments must divide 64 and exceed max_bits")
    rest = BITS - equal * width
    turned = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), (F.col("fp") if not i else F.shiftleft("fp", i * width).bitwiseOR(
            F.shiftrightunsigned("fp", BITS - i * width))).alias("r")) for i in range(segments)])).alias("c")
    rows = fps.select("fp", turned).select("fp", "c.i", "c.r").withColumn("key", F.shiftrightunsigned("r", rest))
    sizes = rows.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut_lineage(rows.join(sizes, ["i", "key"]))
    small = shared.filter(F.col("n") <= pair_limit) if t % 2 == 0 else shared
    a, b = small.alias("a"), small.alias("b")
    differ = F.col("a.r").bitwiseXOR(F.col("b.r"))
    near = (F.col("a.i") == F.col("b.i")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    pairs = a.join(b, near)
    for n in range(equal + 1, segments + 1):  # budgets of the chains; the last is the full distance
        if n == segments or (n * t) // segments < ((n + 1) * t) // segments:
            head = -1 << (BITS - n * width)
            pairs = pairs.filter(F.bit_count(differ.bitwiseAND(F.lit(head))) <= (n * t) // segments)
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if t % 2:
        return pairs
    flips = [sum(1 << x for x in c) for k in range(t // 2 + 1) for c in combinations(range(rest), k)]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]
    meet = (shared.filter(F.col("n") > pair_limit)
            .withColumn("flip", F.explode(F.array(*[F.lit(f) for f in signed])))
            .select("fp", "i", F.col("r").bitwiseXOR(F.col("flip")).alias("at")))
    first = meet.groupBy("i", "at").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return pairs.unionByName(meet.join(first, ["i", "at"]).filter("fp <> v").select(F.col("fp").alias("u"), "v"))


def _rooted(rows: DataFrame, key: str, max_bits: int, segments: int) -> DataFrame:
    """(fp, root, low): the components of the distinct fingerprints and their smallest keys."""
    distinct = rows.groupBy("fp").agg(F.min(key).alias("low"))
    roots = components(links(distinct.select("fp"), max_bits, segments))
    return cut_lineage(distinct.join(roots, distinct["fp"] == roots["node"], "left")
                       .select("fp", "low", F.coalesce("root", "fp").alias("root")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3,
                    max_bits: int = 2, segments: int = 8) -> DataFrame:
    """(key, fp, component_id): the smallest key reachable by links, the row's own included."""
    rows = cut_lineage(fingerprints(df.select(key, text), key, text, words_per_shingle))
    rooted = _rooted(rows, key, max_bits, segments)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3,
             max_bits: int = 2, segments: int = 8) -> DataFrame:
    """One row of each component, in ``df``'s columns: that of the smallest key (null last),
    then the smallest MD5 of the text; of rows equal in both, any one."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    slim = df.select(key, text, digest.alias("__h"))
    rows = cut_lineage(fingerprints(slim, key, text, words_per_shingle, "__h"))
    rooted = _rooted(rows, key, max_bits, segments).select("fp", "root")
    first = rows.join(rooted, "fp").groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.col("__h").alias("h"))).alias("m"))
    keep = first.select(F.col("m.k").alias("__k"), F.col("m.h").alias("__kh"))
    hashed = df.withColumn("__h", digest)
    kept = hashed.join(keep, hashed[key].eqNullSafe(keep["__k"]) & (hashed["__h"] == keep["__kh"]))
    return kept.dropDuplicates(["__k", "__kh"]).select(*df.columns)
