"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global numbers 0..n-1 that depend on the rows alone (not on
files or partitions). A keyed Feistel network permutes the numbers, so the
shard (``p % shards``) and the slot in it (``p div shards``) of every row are
computed without sorting the data into shards, shard sizes differ by at most
one, slots have no gaps, and a rerun gives the same shuffle.

The network works on pairs (x, y) with x < a and y < b, a = ceil(sqrt(n)),
b = ceil(n / a): half rounds ``x = (x + f(y)) mod a`` and ``y = (y + f(x)) mod b``
are bijections for any a and b. Of its a * b values, fewer than a lie at or
beyond n; a number that lands there walks its cycle until it is inside. A cycle
passes each outside value at most once, so a walk over ``a * b - n`` steps always
ends inside, which bounds the work exactly.

Main path: SQL functions only. Global numbers: rows are dealt to 4096 buckets by
the MD5 of the key, counted per bucket (map-side), ranked inside the bucket, and
shifted by the running sum of at most 4096 counts.

Cases: a null key is numbered like any key; repeated rows get numbers of their
own, in an order that only rows equal in all order columns can swap; an empty
table gives an empty table; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hexadecimal digits of the bucket: 16 ** 3 = 4096 buckets at most.
BUCKET_DIGITS = 3
ROUNDS = 6
P1, P2 = 2147483647, 2147483629  # primes below 2 ** 31: products stay inside a long


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """(multiplier, addend, second multiplier) of each half round, from the seed."""
    keys, s = [], seed
    for _ in range(rounds):
        row = []
        for _ in range(3):
            s = (s * 48271 + 11) % P1
            row.append(s % (P1 - 2) + 1)
        keys.append(tuple(row))
    return keys


def mixed(value: str, key: tuple[int, int, int]) -> str:
    """SQL of the round function; the two moduli make it non-linear."""
    return f"((({value} * {key[0]}L + {key[1]}L) % {P1}L) * {key[2]}L % {P2}L)"


def feistel(value: str, a: str, b: str, seed: int) -> str:
    """SQL of the permutation of 0..a*b-1, as a fold over the half rounds."""
    keys = ", ".join(
        f"named_struct('m', {m}L, 'k', {k}L, 'c', {c}L, 'odd', {str(i % 2 == 1).lower()})"
        for i, (m, k, c) in enumerate(round_keys(seed)))
    f = lambda v: f"(((({v}) * r.m + r.k) % {P1}L) * r.c % {P2}L)"
    return (
        f"aggregate(array({keys}), named_struct('x', {value} % {a}, 'y', {value} div {a}), "
        f"(s, r) -> named_struct('x', if(r.odd, s.x, (s.x + {f('s.y')}) % {a}), "
        f"'y', if(r.odd, (s.y + {f('s.x')}) % {b}, s.y)), s -> s.y * {a} + s.x)")


def row_numbers(df: DataFrame, key: str, ties: list[str], out: str = "row_number",
                total: str = "row_total") -> DataFrame:
    """``df`` with gapless global numbers from 0 and the number of rows.

    The order is (MD5 bucket of the key, key, ties).
    """
    tagged = df.withColumn("__bucket", F.substring(
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), 1, BUCKET_DIGITS))
    counts = tagged.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    everything = W.orderBy("__bucket")
    offsets = counts.select(  # at most 4096 rows
        "__bucket",
        (F.sum("__n").over(everything) - F.col("__n")).alias("__offset"),
        F.sum("__n").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(total))
    inside = W.partitionBy("__bucket").orderBy(F.col(key).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties])
    ranked = tagged.withColumn("__rank", F.row_number().over(inside).cast("long") - 1)
    return (ranked.join(F.broadcast(offsets), "__bucket")
            .withColumn(out, F.col("__offset") + F.col("__rank"))
            .drop("__bucket", "__rank", "__offset"))


def shard(df: DataFrame, key: str, ties: list[str], shards: int = 8, seed: int = 1) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long); columns so named are replaced."""
    numbered = row_numbers(df.drop("shard", "slot"), key, ties, "__row", "__total")
    sized = (numbered.withColumn("__a", F.ceil(F.sqrt(F.col("__total").cast("double"))).cast("long"))
             .withColumn("__b", F.expr("(__total + __a - 1) div __a")))
    first = sized.withColumn("__p", F.expr(feistel("__row", "__a", "__b", seed)))
    walked = first.withColumn("__q", F.expr(
        "aggregate(if(__p < __total, array(), sequence(1L, __a * __b - __total)), __p, "
        f"(v, i) -> if(v < __total, v, {feistel('v', '__a', '__b', seed)}))"))
    return (walked.withColumn("shard", (F.col("__q") % shards).cast("int"))
            .withColumn("slot", F.expr(f"__q div {shards}"))
            .drop("__row", "__total", "__a", "__b", "__p", "__q"))
