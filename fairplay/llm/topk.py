"""Exact top-k by inner product in three phases with a uniform threshold.

Vectors are cut into ``groups`` of dimensions. For a query, each group is a list of
partial scores over all candidates, and a candidate's score is the sum of its
entries. (1) Every task gathers the k best entries of each list among its rows and
each list's minimum; what these entries add up to per row, with the minima for entries
not seen, bounds the k-th best score from below: the cutoff. Rows are told apart by a
number of their own, as an id may stand in several rows. (2) The cutoff of every
query is broadcast. Taken above the minima and divided by the number of lists it is
the uniform threshold: a candidate that reaches the cutoff has an entry at or above
it, so candidates without such an entry are dropped. (3) Those whose entries above
the threshold, with the threshold for the rest, cannot reach the cutoff are dropped
too; the rest get their exact scores, and each task returns at most the k best per
query, in the final order (score, then smaller id), so equal scores stay exact.

Queries are taken in blocks of at most ``block`` rows, which bounds what is broadcast
(a block, its cutoffs and minima); every block meets all rows, task by task, and no
pair is written but these few.

Scores are exact whole numbers: doubles only where all sums stay below 2^53, 64-bit
integers below 2^63, and Python's integers beyond. What prunes (cutoffs, thresholds,
bounds) is in doubles, with room for their rounding in proportion to what was added up.
A component beyond 64 bits, or a score among the best beyond them, is an error.

Cases: rows without an id, and vectors that are null or hold a null, NaN or infinite
component, take no part, neither as queries nor as candidates;
missing components of shorter vectors count as 0; rows with the query's own id are
no candidates; an id in several rows is a candidate with each of them; a query row
that is repeated is answered each time; fewer candidates
than k give all of them; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairplay.llm.common import write_table

ROWS = 512  # candidates scored at once


def quantized(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(row, id, v): integer components floor(scale * x) of the vectors that take part.

    ``row`` is unique, and stays the same once the table is written.
    """
    x = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.when(F.abs(c * scale) < 2.0 ** 63, F.floor(c * scale)).otherwise(
        F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return x.filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(~odd).select(
        F.monotonically_increasing_id().alias("row"), "id", F.transform("x", whole).alias("v"))


def matrix(vectors: list, width: int) -> np.ndarray:
    m = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(m, vectors, strict=True):
        v = np.asarray(v, np.int64)[:width]
        row[:len(v)] = v
    return m


class Block:
    """The queries of a block, with exact partial scores by group of dimensions."""

    def __init__(self, ids: list[int], vectors: list, groups: int):
        self.ids = np.array(ids, np.int64)
        width = max(map(len, vectors))
        self.q = matrix(vectors, width)
        bounds = np.linspace(0, width, min(groups, max(1, width)) + 1).astype(int)
        self.cuts = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def partials(self, candidates: np.ndarray) -> list[np.ndarray]:
        """Per group the (query, candidate) scores: as doubles or 64-bit integers where these are exact."""
        size = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
        reach = size(self.q) * size(candidates) * self.q.shape[1]
        kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 63 else object
        return [self.q[:, c].astype(kind) @ candidates[:, c].astype(kind).T for c in self.cuts]

    def pieces(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(row numbers, candidate ids, own-row mask, partial scores) a few rows at a time."""
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at:at + ROWS]
                ids = part["id"].to_numpy(np.int64)
                yield part["row"].to_numpy(np.int64), ids, self.ids[:, None] == ids[None, :], self.partials(matrix(list(part["v"]), self.q.shape[1]))



def gather(block: Block, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Phase 1 of a task: (q, g, low, row numbers, scores) of its rows."""
    n, groups = len(block.ids), len(block.cuts)
    low = np.full((groups, n), np.inf)
    top = np.full((groups, n, k), -np.inf)
    top_rows = np.full((groups, n, k), -1, np.int64)
    for numbers, _, own, partials in block.pieces(batches):
        for g, s in enumerate(partials):
            s = s.astype(np.float64)
            low[g] = np.minimum(low[g], np.where(own, np.inf, s).min(axis=1))
            s = np.where(own, -np.inf, s)
            rows = np.flatnonzero(s.max(axis=1) > top[g, :, -1])
            if len(rows):
                all_s = np.concatenate([top[g, rows], s[rows]], axis=1)
                all_i = np.concatenate([top_rows[g, rows], np.broadcast_to(numbers, (len(rows), len(numbers)))], axis=1)
                at = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
                top[g, rows], top_rows[g, rows] = np.take_along_axis(all_s, at, 1), np.take_along_axis(all_i, at, 1)
    out = []
    for g in range(groups):
        for q in range(n):
            if np.isfinite(low[g, q]):
                real = np.isfinite(top[g, q])
                out.append((q, g, low[g, q], top_rows[g, q][real], top[g, q][real]))
    yield pd.DataFrame(out, columns=["q", "g", "low", "rows", "scores"])


def resolve(block: Block, cutoff: np.ndarray, low: np.ndarray, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Phases 2 and 3 of a task: its k best candidates per query that reach the cutoff."""
    n, groups = len(block.ids), len(block.cuts)
    room = 1 + np.abs(cutoff) + np.abs(low).sum(axis=0)  # rounding is in proportion to what was added
    uniform = low + (cutoff - low.sum(axis=0)) / groups - 1e-9 * room  # per group and query
    top, top_ids, real = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
    for _, ids, own, partials in block.pieces(batches):
        above = np.zeros(own.shape, bool)
        bound, added = np.zeros(own.shape), np.zeros(own.shape)
        for s, t in zip(partials, uniform, strict=True):
            s = s.astype(np.float64)
            over = s >= t[:, None]
            above |= over
            most = np.where(over, s, t[:, None])
            bound += most
            added += np.abs(most)
        alive = above & ~own & (bound + 1e-9 * added >= (cutoff - 1e-8 * room)[:, None])
        rows = np.flatnonzero(alive.any(axis=1))
        if not len(rows):
            continue
        all_s = np.concatenate([top[rows], whole(sum(s[rows] for s in partials), alive[rows])], axis=1)
        all_i = np.concatenate([top_ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        all_r = np.concatenate([real[rows], alive[rows]], axis=1)
        at = np.lexsort((all_i, ~all_s, ~all_r), axis=1)[:, :k]
        top[rows], top_ids[rows], real[rows] = (np.take_along_axis(x, at, 1) for x in (all_s, all_i, all_r))
    q, r = np.nonzero(real)
    yield pd.DataFrame({"q": q, "query_id": block.ids[q], "vec_id": top_ids[q, r], "score": top[q, r]})


def whole(scores: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; those that are not used are 0."""
    if scores.dtype == object and any(abs(x) >= 1 << 63 for x in scores[used]):
        raise OverflowError("a score is beyond 64 bits")
    return np.where(used, scores, 0).astype(np.int64)


def search(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
           scale: float = 1024.0, groups: int = 4, block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query row.

    ``is_query``: a condition on the column ``id``.
    """
    rows = write_table(quantized(df, key, vector, scale), "vectors")
    results, held = [], []

    def finish() -> None:
        part = _block(rows, Block([r["id"] for r in held], [r["v"] for r in held], groups), k)
        results.append(part)
        held.clear()

    for r in rows.filter(is_query).orderBy("id").toLocalIterator():  # the driver holds one block
        held.append(r)
        if len(held) == block:
            finish()
            results[-1] = write_table(results[-1], "top-k")
    if held:
        finish()
    if not results:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out


def _block(rows: DataFrame, queries: Block, k: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast(queries)  # at most ``block`` queries
    lists = write_table(rows.mapInPandas(lambda b: gather(sent.value, k, b),
                                         "q int, g int, low double, rows array<long>, scores array<double>"), "lists")
    lows = lists.groupBy("q", "g").agg(F.min("low").alias("low"))
    entries = lists.select("q", "g", F.explode(F.arrays_zip("rows", "scores")).alias("e")).select(
        "q", "g", F.col("e.rows").alias("row"), F.col("e.scores").alias("s"))
    best = W.partitionBy("q", "g").orderBy(F.col("s").desc(), "row")
    entries = entries.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    floor = lows.groupBy("q").agg(F.sum("low").alias("floor"))
    sums = (entries.join(lows, ["q", "g"]).groupBy("q", "row").agg(F.sum(F.col("s") - F.col("low")).alias("over"))
            .join(floor, "q").withColumn("least", F.col("over") + F.col("floor")))
    kth = (sums.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.col("least").desc())))
           .filter(F.col("r") == k).select("q", "least"))
    n, groups = len(queries.ids), len(queries.cuts)
    cutoff, low = np.full(n, -np.inf), np.zeros((groups, n))
    for q, g, x in lows.collect():  # a number per query and group of the block
        low[g, q] = x
    for q, least in kth.collect():
        cutoff[q] = least
    cutoff = np.where(np.isfinite(cutoff), cutoff, np.minimum(low.sum(axis=0), 0) - 1e300)
    told = sc.broadcast((cutoff, low))
    found = rows.mapInPandas(lambda b: resolve(sent.value, *told.value, k, b), "q int, query_id long, vec_id long, score long")
    ranks = W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
