"""A dataset manifest as a Merkle tree per group, with proofs and persistent versions.

A leaf is the digest of a row's columns, a node that of its run of ``arity`` children
(the last run may be shorter). Leaves are numbered in order inside their group, over
ranges of the whole order, and cut into aligned blocks of ``arity ** levels``: a run
never crosses a block, so a block's subtree is built by one small task, and the block
roots are the leaves of the next tier, which is cut into blocks the same way, until one
node per group is left; the groups' roots make the last tree.

The trees are persistent: a changed leaf makes a new version of its block's tree by path
copying. Only the ancestors of the leaf are made anew, all other nodes are those of the
original, which no version touches; so a version costs a path, whatever the number of
changed leaves. Its block root goes up like any node: the siblings above are taken from
the original tiers and joined to the rows by block, and SQL folds them.

Nothing is gathered but a block; a group that holds a third of the rows is as many
blocks as it needs.

Cases: a null column is ``-``; a null group is a group of its own, before all others;
null keys come first, equal keys by their leaf digest; repeated rows are leaves each; a
group of one row has its leaf as root; an empty table gives an empty table; texts are
digested whole; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairplay.llm.common import carried, write_table
from fairplay.plans.joins import bounded_broadcast
from fairplay.plans.windows import ordered_index

LEVELS = 10  # of a block: 1024 leaves of a binary tree


def digest(columns: Sequence[Column]) -> Column:
    """Hexadecimal SHA-256 of the columns, each ``-`` or its size in bytes, ``:`` and its text."""
    told = lambda s: F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[told(c.cast("string")) for c in columns]), 256)


def combined(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


class Tree:
    """A block's nodes, level by level from its leaves. Versions share them."""

    def __init__(self, leaves: list[str], arity: int, height: int | None):
        """``height``: levels above the leaves; None: until one node is left."""
        self.arity, self.levels = arity, [leaves]
        while len(self.levels[-1]) > 1 if height is None else len(self.levels) <= height:
            below = self.levels[-1]
            self.levels.append([combined(below[i:i + arity]) for i in range(0, len(below), arity)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> Iterator[tuple[list[str], list[str]]]:
        """(before, after) the path of leaf ``at``, from its level up."""
        for nodes in self.levels[:-1]:
            first = at - at % self.arity
            yield nodes[first:at], nodes[at + 1:first + self.arity]
            at //= self.arity

    def version(self, at: int, leaf: str) -> list[str]:
        """The copied path of a version in which leaf ``at`` is ``leaf``: from the leaf to its root."""
        path = [leaf]
        for before, after in self.siblings(at):
            path.append(combined([*before, path[-1], *after]))
        return path


def block_of(arity: int, levels: int, paths: bool):
    """Function of a block's rows (pos, total, node, changed) for ``applyInPandas``.

    With ``paths``, siblings are texts by level, before and after; else their digests in a row.
    """
    size = arity ** levels

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        tree = Tree([bytes(x).hex() for x in pdf["node"]], arity, None if pdf["total"].iloc[0] <= size else levels)
        out = pdf[["grp", "pos"] if paths else ["key", "grp", "pos", "node", "changed"]].copy()
        around = [list(tree.siblings(i)) for i in range(len(pdf))]
        if paths:
            out["before"] = [["".join(b) for b, _ in x] for x in around]
            out["after"] = [["".join(a) for _, a in x] for x in around]
        else:
            out["siblings"] = [bytes.fromhex("".join(["".join(b + a) for b, a in x])) for x in around]
            out["version"] = [None if x is None else tree.version(i, bytes(x).hex())[-1] for i, x in enumerate(pdf["changed"])]
        out["root"] = tree.root
        return out

    return build


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 inside ``grp``) and ``total`` (rows of the group)."""
    placed = ordered_index(rows, ["grp"], order, "pos").withColumn("pos", F.col("pos") - 1)
    sizes = write_table(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("total")), "group-sizes")
    return placed.join(bounded_broadcast(sizes), "grp")


def tier(nodes: DataFrame, arity: int, levels: int, paths: bool = True) -> DataFrame:
    """The blocks of ``nodes`` (grp, pos, total, node; without paths also key and changed), written."""
    size = arity ** levels
    blocks = nodes.groupBy("grp", F.expr(f"pos div {size}").alias("block"))
    kind = ("grp string, pos long, before array<string>, after array<string>" if paths else
            f"key {dict(nodes.dtypes)['key']}, grp string, pos long, node binary, changed binary, siblings binary, version string")
    return write_table(blocks.applyInPandas(block_of(arity, levels, paths), kind + ", root string"), "tier")


def above(blocks: DataFrame, totals: DataFrame, size: int) -> DataFrame:
    """A tier's block roots as the nodes of the next."""
    first = blocks.filter(F.col("pos") % size == 0).select("grp", F.expr(f"pos div {size}").alias("pos"), F.unhex("root").alias("node"))
    return first.join(bounded_broadcast(totals), "grp")


def climbed(nodes: DataFrame, totals: DataFrame, most: int, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """(tiers above, a root per group) of ``nodes``, the roots of the blocks below."""
    size, tiers = arity ** levels, []
    while most > 1:
        tiers.append(tier(nodes, arity, levels))
        totals = totals.withColumn("total", F.ceil(F.col("total") / size))
        nodes, most = above(tiers[-1], totals, size), -(-most // size)
    return tiers, nodes.select("grp", F.col("node").alias("subroot"))


def joined_paths(tiers: list[DataFrame], size: int) -> DataFrame | None:
    """(grp, pos, before, after): the whole path of every node of the lowest tier."""
    out = None
    for x in reversed(tiers):
        x = x.select("grp", "pos", "before", "after", F.expr(f"pos div {size}").alias("up"))
        if out is not None:
            more = out.select("grp", F.col("pos").alias("up"), F.col("before").alias("b"), F.col("after").alias("a"))
            x = x.join(more, ["grp", "up"]).withColumns({"before": F.concat("before", "b"), "after": F.concat("after", "a")})
        out = x.select("grp", "pos", "before", "after")
    return out


def manifest(df: DataFrame, columns: Sequence[str], key: str = "doc_id", group: str = "lang", arity: int = 2,
             levels: int = LEVELS, changes: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof, changed, folded_root) of every row, digests in hexadecimal.

    ``proof``: digest of the siblings from the leaf to the root, left to right. ``changes`` are
    new values of columns in the rows where ``when`` holds; ``folded_root`` is the root that
    the row's version gives with the original siblings, ``changed`` its other leaf or null.
    """
    size = arity ** levels
    leaf = digest([F.col(c) for c in columns])
    other = F.when(when, digest([(changes or {}).get(c, F.col(c)) for c in columns])) if when is not None else F.lit(None).cast("string")
    kind = dict(df.dtypes)[key]
    rows = write_table(df.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),  # null first
        F.unhex(leaf).alias("node"), F.unhex(other).alias("changed")), "leaves")
    placed = numbered(rows, ["key", "node", "row"])
    lowest = tier(placed.select(F.col("key").cast(carried(kind)), "grp", "pos", "total", "node", "changed"), arity, levels, paths=False)
    totals = write_table(rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("total")), "block-counts")
    tiers, subroots = climbed(above(lowest, totals, size), totals, totals.agg(F.max("total")).first()[0] or 0, arity, levels)
    out = _proved(lowest, tiers, write_table(subroots, "subroots"), arity, levels)
    return out.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def _proved(lowest: DataFrame, tiers: list[DataFrame], subroots: DataFrame, arity: int, levels: int) -> DataFrame:
    """The rows with their paths: block, tiers of the group, and the tree of the groups' roots."""
    size = arity ** levels
    named = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("node"))
    top = write_table(numbered(named, ["name"]), "top")
    groups = top.count()
    top_tiers, last = climbed(top.select("grp", "pos", "total", "node"), top.select("grp", "total").limit(1), groups, arity, levels)
    root = (last.select(F.lower(F.hex("subroot"))).first() or [None])[0]  # one node
    nothing = F.array().cast("array<string>")
    names = top.select(F.col("name").alias("grp"), "pos", F.lower(F.hex("node")).alias("subroot"))
    if top_tiers:
        over = joined_paths(top_tiers, size).select("pos", F.col("before").alias("b"), F.col("after").alias("a"))
        names = names.join(over, "pos")
    else:
        names = names.withColumns({"b": nothing, "a": nothing})
    if tiers:
        paths = joined_paths(tiers, size).withColumnRenamed("pos", "block").join(bounded_broadcast(names.drop("pos")), "grp")
    else:
        paths = names.drop("pos").withColumns({"block": F.lit(0).cast("long"), "before": nothing, "after": nothing})
    path = F.arrays_zip(F.concat("before", "b").alias("before"), F.concat("after", "a").alias("after"))
    paths = write_table(paths.select("grp", "block", "subroot", path.alias("path")), "paths")
    found = lowest.withColumn("block", F.expr(f"pos div {size}")).join(paths, ["grp", "block"])
    up = F.aggregate("path", F.coalesce("version", "root"), lambda node, p: F.sha2(F.concat(p["before"], node, p["after"]), 256))
    proof = F.sha2(F.concat(F.lower(F.hex("siblings")), F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")), 256)
    return found.select("key", F.lower(F.hex("node")).alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
                        proof.alias("proof"), F.lower(F.hex("changed")).alias("changed"), up.alias("folded_root"))
