"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.
Sorting every suffix would move ``length`` bytes per byte of text, so only suffixes
that can matter are sorted:

* Every window of ``length`` bytes has an anchor: the place of the smallest hash of 8 bytes
  among its first ``places``. Equal windows have their anchor at the same offset,
  so each window belongs to one anchor, and windows can only be equal if the ``key``
  bytes after their anchors are (that many lie in each of them). Anchors whose key occurs
  once are dropped by an exact count over the whole table. This loses no pair of equal windows.
* For the count, a batch of anchors keeps those whose key it has twice itself, and sends one
  anchor of each key on, packed in sorted blobs by ranges of the key's hash; where they meet,
  a key is a row per batch at most, however many anchors have it.
* What is left are the suffixes at repeated anchors: the bytes of an anchor's windows
  from the anchor on, then those before it in reverse. Every task sorts its own into a
  run, folds equal ones, front-codes it (length of the prefix shared with the suffix
  before, then the rest) and deals it to ranges by the hash of the key, so that suffixes
  that must meet do; a key with many anchors has a range of its own. A range merges its
  runs with a loser tree that keeps, for every run's head, the length of the prefix it shares
  with the last suffix put out: a longer shared prefix wins at once, and on a tie bytes
  are compared only beyond it. Many runs are merged in turns of ``FAN_IN``.
* In the merged order, suffixes that share d bytes are neighbours. A window that
  begins l bytes before its anchor repeats if another suffix shares ``length`` - l bytes
  after the anchor (a run of the merged order) and l bytes before it (a run of the
  order of the reversed fronts); both runs are exact, for each l in turn. Longer strings
  are found in the same order: equal ones begin with equal windows, so their anchors meet.

Copies: texts are known by their MD5; a text of ``length`` bytes or more in several rows
is removed whole, and is sorted once per task. A passage in more than ``class_limit``
rows (with different surroundings) is not gathered in one range: its distinct contexts
are counted by digest, its windows by digest of their bytes, in plain aggregates.
Nothing is capped. Only texts with a repeated anchor are looked at again to be cut.

Cases: null text is empty; texts under ``length`` bytes keep everything; repeated rows are
copies; an empty table gives an empty table; texts of any length are read whole, in
overlapping stretches; matches never cross texts; other columns do not matter, and
``clean`` returns them as they are. In ``clean`` a character that lost some of its
bytes is dropped, and runs of fewer than ``least_words`` words (those they cut counted) stay.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairplay.llm.common import n_words, text_or_empty, write_table
from fairplay.plans.joins import bounded_broadcast

LENGTH = 400
STRETCH = 1 << 20
FAN_IN = 256
RUN_BYTES = 16 << 20
BATCH = 1 << 17  # anchors counted together before they are sent on
LOW = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Window:
    """The lengths of the strings that are looked for, and what follows from the shortest."""

    lengths: tuple[int, ...]

    def __post_init__(self):
        if min(self.lengths) < 32:
            raise ValueError("length must be 32 bytes or more")

    @property
    def length(self) -> int:
        return min(self.lengths)

    @property
    def longest(self) -> int:
        return max(self.lengths)

    @property
    def tail(self) -> int:
        """Bytes behind a sorted suffix: the largest distance of a window, and the smallest by length."""
        return 1 + len(self.lengths)

    @property
    def places(self) -> int:
        """An anchor is within the first so many bytes of its window."""
        return min(255, self.length * 12 // 25)

    @property
    def key(self) -> int:
        """Bytes after the anchor that lie in each of its windows."""
        return self.length - self.places

    @property
    def width(self) -> int:
        """Bytes of a sorted suffix: what follows the anchor, then the reversed front."""
        return self.longest + self.places


def anchors(raw: bytes, w: Window) -> Iterator[tuple[int, int, int]]:
    """(anchor, smallest and largest distance of its windows' starts before it)."""
    for base in range(0, len(raw) - w.length + 1, STRETCH):
        part = raw[base:base + STRETCH + w.length - 1]
        windows = len(part) - w.length + 1
        eight = np.ndarray((windows + w.places - 1,), "<u8", part, strides=(1,)).astype(np.uint64)
        eight *= np.uint64(0x9E3779B97F4A7C15)
        eight ^= eight >> np.uint64(29)
        eight *= np.uint64(0xBF58476D1CE4E5B9)
        low = (eight & ~LOW) | np.arange(len(eight), dtype=np.uint64)
        span = 1
        while span * 2 <= w.places:  # minimum over spans of doubling length
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < w.places:
            low = np.minimum(low[:len(low) - (w.places - span)], low[w.places - span:])
        at = (low & LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        for a, p, q in zip(at[first].tolist(), first.tolist(), last.tolist(), strict=True):
            yield base + a, a - q, a - p


ANCHOR = np.dtype([("key", "<u8"), ("t", "<i8"), ("place", "<i8"), ("n", "<i8")])


def counted(anchors_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors with counts -> (one per key, with all its counts; those of repeated keys): a key
    is repeated if it is in several places, or was in one of the batches (a count above 1)."""
    table = anchors_of[np.lexsort((anchors_of["place"], anchors_of["t"], anchors_of["key"]))]
    new_key = np.concatenate([[True], table["key"][1:] != table["key"][:-1]])
    new_place = new_key | np.concatenate([[True], (table["t"][1:] != table["t"][:-1]) | (table["place"][1:] != table["place"][:-1])])
    first = np.flatnonzero(new_key)
    which = np.cumsum(new_key) - 1
    ones = table[first].copy()
    ones["n"] = np.add.reduceat(table["n"], first)
    several = (np.add.reduceat(new_place.astype(np.int64), first) > 1) | (np.maximum.reduceat(table["n"], first) > 1)
    found = table[several[which] & new_place].copy()
    found["n"] = ones["n"][which[several[which] & new_place]]
    return ones, found


def blobs(table: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, blob) of anchors, by the hash of the key; column by column, in order of the key."""
    part = (table["key"] >> np.uint64(16)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    table, part = table[order], part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(table)], strict=True):
        rows = table[a:b]
        step = np.diff(rows["key"], prepend=np.uint64(0))
        body = b"".join([step.tobytes(), rows["t"].tobytes(), rows["place"].tobytes(), rows["n"].tobytes()])
        yield int(part[a]), struct.pack("<I", b - a) + zstandard.compress(body, 1)


def unpacked(blob: bytes) -> np.ndarray:
    n, body = struct.unpack_from("<I", blob)[0], zstandard.decompress(blob[4:])
    table = np.empty(n, ANCHOR)
    table["key"] = np.cumsum(np.frombuffer(body, "<u8", n), dtype=np.uint64)
    for i, c in enumerate(("t", "place", "n"), 1):
        table[c] = np.frombuffer(body, "<i8", n, 8 * n * i)
    return table


def as_rows(table: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"key": table["key"].astype(np.int64), **{c: table[c] for c in ("t", "place", "n")}})


def found_anchors(w: Window, parts: int):
    """Function of a task's texts: a row (part, blob) of packed anchors, one of each key and
    batch, or an anchor (key, t, place, n) whose key its batch has in several places."""

    def flushed(held: list[tuple[int, int, int]]) -> pd.DataFrame:
        table = np.empty(len(held), ANCHOR)
        for i, c in enumerate(("key", "t", "place")):
            table[c] = np.fromiter((x[i] for x in held), ANCHOR[c], len(held))
        table["n"] = 1
        ones, several = counted(table)
        packed = pd.DataFrame(list(blobs(ones, parts)), columns=["part", "blob"])
        return pd.concat([packed.assign(key=0, t=0, place=0, n=0), as_rows(several).assign(part=-1, blob=None)])[
            ["part", "blob", "key", "t", "place", "n"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        held: list[tuple[int, int, int]] = []
        for pdf in batches:
            for text in pdf["t"]:
                raw = (text or "").encode()
                digest = hashlib.md5(raw).digest()
                if len(raw) < w.length or digest in seen:
                    continue
                seen.add(digest)
                t = int.from_bytes(digest[:8], "big", signed=True)
                for a, near, far in anchors(raw, w):
                    held.append((xxhash.xxh3_64_intdigest(raw[a:a + w.key]), t, a << 16 | near << 8 | far))
                    if len(held) >= BATCH:
                        yield flushed(held)
                        held = []
        if held:
            yield flushed(held)

    return run


def met(pdf: pd.DataFrame) -> pd.DataFrame:
    """A range of keys: the anchors of those that are in several places."""
    return as_rows(counted(np.concatenate([unpacked(b) for b in pdf["blob"]]))[1])


def packed_texts(w: Window):
    """Function of a task's texts: (t, h, packed) of the distinct ones that are long enough; h: their MD5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=1).compress
        for pdf in batches:
            out = []
            for text in pdf["t"]:
                raw = (text or "").encode()
                digest = hashlib.md5(raw).digest()
                if len(raw) >= w.length and digest not in seen:
                    seen.add(digest)
                    out.append((int.from_bytes(digest[:8], "big", signed=True), digest, pack(raw)))
            yield pd.DataFrame(out, columns=["t", "h", "packed"])

    return run


def suffix(raw: bytes, a: int, near: int, far: int, w: Window) -> bytes:
    """The sorted form of an anchor's windows, with their distances at the end (255: none of a length)."""
    after = raw[a:a - near + w.longest].ljust(w.longest, b"\0")
    fits = (max(near, a + n - len(raw)) for n in w.lengths)
    return after + raw[a - far:a][::-1].ljust(w.places, b"\0") + bytes((far, *(min(x, 255) for x in fits)))


def shared(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 8192):
        end = min(len(rows), at + 8192)
        differ = rows[at:end] != rows[at - 1:end - 1]
        out[at:end] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def front_coded(items: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (suffix, occurrences), compressed."""
    width = len(items[0][0])
    table = np.frombuffer(b"".join(s for s, _ in items), np.uint8).reshape(len(items), width)
    same = shared(table)
    tails = b"".join(s[n:] for (s, _), n in zip(items, same.tolist(), strict=True))
    sizes = np.array([len(o) for _, o in items], "<u4").tobytes()
    body = same.astype("<u2").tobytes() + sizes + tails + b"".join(o for _, o in items)
    return struct.pack("<II", len(items), width) + zstandard.compress(body, 3)


def opened(blob: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """(suffix, bytes shared with the one before, occurrences) of a front-coded run."""
    (n, width), body = struct.unpack_from("<II", blob), zstandard.decompress(blob[8:])
    same = np.frombuffer(body, "<u2", n).tolist()
    sizes = np.frombuffer(body, "<u4", n, 2 * n).tolist()
    at, occ, last = 6 * n, 6 * n + n * width - sum(same), b""
    for s, size in zip(same, sizes, strict=True):
        end = at + width - s
        last = last[:s] + body[at:end]
        yield last, s, body[occ:occ + size]
        at, occ = end, occ + size


def merged(blobs: list[bytes]) -> Iterator[tuple[bytes, int, bytes]]:
    """The runs in one order, by a loser tree; equal suffixes as one.

    ``lcp[r]`` is what run r's head shares with the last suffix put out. Of two heads the
    one that shares more comes first; if both share h, bytes are compared from h on, and the
    loser then shares with the winner what was found equal. Inner nodes hold losers.
    """
    runs = [opened(b) for b in blobs]
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    lcp = [0] * k
    tree = [0] * (2 * k)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's shared length to what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        h = lcp[a]
        s, t = x[0][h:], y[0][h:]
        if s == t:
            lcp[b] = h + len(s)
            return a, b
        differ = int.from_bytes(s, "big") ^ int.from_bytes(t, "big")
        h += len(s) - (differ.bit_length() + 7) // 8
        if s < t:
            lcp[b] = h
            return a, b
        lcp[a] = h
        return b, a

    winners = [0] * (2 * k)
    for r in range(k):
        winners[k + r] = r
    for node in range(k - 1, 0, -1):
        winners[node], tree[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if k > 1 else 0
    last, last_shared, occurrences = None, 0, []
    while heads[best] is not None:
        s, _, occ = heads[best]
        if last is not None and lcp[best] == len(s):
            occurrences.append(occ)
        else:
            if last is not None:
                yield last, last_shared, b"".join(occurrences)
            last, last_shared, occurrences = s, lcp[best], [occ]
        heads[best] = nxt = next(runs[best], None)
        if nxt is not None:
            lcp[best] = nxt[1]  # its run's front coding: shared with what was just put out
        node = (k + best) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2
    if last is not None:
        yield last, last_shared, b"".join(occurrences)


OCCURRENCE = 20  # bytes: MD5 of the text (16) and anchor (4)


def several(occurrences: bytes) -> bool:
    """Whether a suffix stands in more than one place."""
    first = occurrences[:OCCURRENCE]
    return len(occurrences) > OCCURRENCE and any(
        occurrences[i:i + OCCURRENCE] != first for i in range(OCCURRENCE, len(occurrences), OCCURRENCE))


def repeated(suffixes: list[bytes], after: np.ndarray, multiple: np.ndarray, w: Window) -> list[np.ndarray]:
    """By length, (suffix, l): whether its window that begins l bytes before the anchor occurs elsewhere.

    ``suffixes`` are distinct and sorted, ``after`` are the bytes each shares with the one before.
    """
    n = len(suffixes)
    table = np.frombuffer(b"".join(suffixes), np.uint8).reshape(n, w.width + w.tail)
    far = table[:, w.width].astype(np.int64)
    fronts = np.ascontiguousarray(table[:, w.longest:w.width])
    order = np.argsort(fronts.view(f"S{w.places}").ravel(), kind="stable")
    before = np.empty(n, np.int64)
    out = [np.zeros((n, w.places), bool) for _ in w.lengths]
    common = shared(fronts[order])
    for distance in range(w.places):
        before[order] = np.cumsum(common < distance)
        for k, length in enumerate(w.lengths):
            rows = np.flatnonzero((table[:, w.width + 1 + k] <= distance) & (distance <= far))
            if not len(rows):
                continue
            right = np.cumsum(after < length - distance)
            both = right[rows] * (n + 1) + before[rows]
            by = np.argsort(both, kind="stable")
            same = both[by][1:] == both[by][:-1]
            hit = np.zeros(len(rows), bool)
            hit[by[1:][same]] = True
            hit[by[:-1][same]] = True
            out[k][rows, distance] = hit | multiple[rows]
    return out


def spans_of(windows: np.ndarray) -> list[tuple[int, int]]:
    """Runs of distances (first, last) in a row of ``repeated``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], windows.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def covered(found: dict[tuple[bytes, int], list[tuple[int, int]]]) -> pd.DataFrame:
    rows = [(h, length, np.array(union(s), "<u4").tobytes()) for (h, length), s in found.items()]
    return pd.DataFrame(rows, columns=["h", "length", "spans"])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def settle(w: Window):
    """Function of a range: its runs merged, and the repeated bytes (h, length, spans) of its texts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        suffixes, same, occurrences = [], [], []
        for s, n, occ in merged(list(pdf["blob"])):
            suffixes.append(s)
            same.append(n)
            occurrences.append(occ)
        if not suffixes:
            return covered({})
        multiple = np.fromiter(map(several, occurrences), bool, len(occurrences))
        found: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
        for length, hits in zip(w.lengths, repeated(suffixes, np.array(same), multiple, w), strict=True):
            for i in np.flatnonzero(hits.any(axis=1)).tolist():
                runs = spans_of(hits[i])
                for h, a in struct.iter_unpack("<16sI", occurrences[i]):
                    found.setdefault((h, length), []).extend((a - hi, a - lo + length) for lo, hi in runs)
        return covered(found)

    return run


def joined_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Several runs of a range as one."""
    items = [(s, occ) for s, _, occ in merged(list(pdf["blob"]))]
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "run": [pdf["run"].iloc[0]], "blob": [front_coded(items)]})


def repeated_anchors(texts: DataFrame, w: Window, per_range: int, class_limit: int, per_part: int) -> DataFrame:
    """(t, place, range, frequent) of the anchors whose key is in several places; written.

    A key of more than ``per_range`` anchors has a range of its own.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, 2 * size // w.places // per_part)
    schema = "key long, t long, place long, n long"
    packed = write_table(texts.mapInPandas(found_anchors(w, parts), f"part int, blob binary, {schema}"), "anchors")
    known = packed.filter("part < 0").select("key", "t", "place", "n")  # n: in its batch
    kept = write_table(packed.filter("part >= 0").groupBy("part").applyInPandas(met, schema).unionByName(known), "repeated-anchors")
    heavy = write_table(kept.filter(F.col("n") > per_range).groupBy("key").agg(F.max("n").alias("all")), "heavy-keys")
    ranges = max(least, kept.count() // per_range)
    own = F.when(F.col("all").isNull(), F.pmod("key", F.lit(ranges))).otherwise(F.lit(ranges) + F.shiftrightunsigned("key", 2))
    return kept.join(bounded_broadcast(heavy), "key", "left").select(
        "t", "place", own.alias("range"), (F.coalesce("all", F.lit(0)) > class_limit).alias("frequent"))


def repeated_spans(df: DataFrame, text: str = "text", lengths: tuple[int, ...] = (LENGTH,), class_limit: int = 50_000, per_range: int = 12_000,
                   per_part: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the distinct texts of ``df`` with repeated anchors (t, h, packed), and what
    repeats in or between them (h, length, spans); h: the text's MD5, spans: (start, end) pairs as
    little-endian 32-bit integers, possibly in several rows per text. Copies of whole texts
    are not looked at here. (Where only t, 8 bytes of the MD5, stands for a text, two texts
    with one t can at most add anchors that are then checked in vain.)"""
    w = Window(lengths)
    texts = df.select(F.col(text).alias("t"))
    marked = repeated_anchors(texts, w, per_range, class_limit, per_part)
    wanted = marked.groupBy("t").agg(F.collect_set(F.when(~F.col("frequent"), F.struct("place", "range"))).alias("at"),
                                     F.collect_set(F.when(F.col("frequent"), F.col("place"))).alias("often"))
    wanted = wanted.select("t", F.transform("at", lambda x: x["place"]).alias("at"), F.transform("at", lambda x: x["range"]).alias("to"), "often")
    packed = texts.mapInPandas(packed_texts(w), "t long, h binary, packed binary")
    chosen = write_table(packed.join(wanted, "t"), "chosen-texts")

    def make_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, size, ranges = TaskContext.get().partitionId() << 24, 0, {}
        for pdf in batches:
            for h, blob, at, to in zip(pdf["h"], pdf["packed"], pdf["at"], pdf["to"], strict=True):
                raw = zstandard.decompress(blob)
                for place, part in zip(at.tolist(), to.tolist(), strict=True):
                    a, near, far = place >> 16, place >> 8 & 255, place & 255
                    if a < far or a - near + w.length > len(raw):
                        continue  # another text with the same t
                    s = suffix(raw, a, near, far, w)
                    occ = ranges.setdefault(part, {}).setdefault(s, set())
                    size += 40 if occ else w.width + 150
                    occ.add(struct.pack("<16sI", h, a))
                if size > RUN_BYTES:
                    yield dealt_run(ranges, run)
                    run, size, ranges = run + 1, 0, {}
        if ranges:
            yield dealt_run(ranges, run)

    pieces = write_table(chosen.filter(F.size("at") > 0).select("h", "packed", "at", "to").mapInPandas(
        make_runs, "part long, run long, blob binary"), "suffix-runs")
    n = pieces.agg(F.count_distinct("run")).first()[0]
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        pieces = pieces.groupBy("part", F.pmod(F.xxhash64("run"), F.lit(n)).alias("to")).applyInPandas(
            joined_runs, "part long, run long, blob binary")
    found = pieces.groupBy("part").applyInPandas(settle(w), "h binary, length int, spans binary")
    frequent = chosen.filter(F.size("often") > 0).select("h", "packed", F.col("often").alias("at"))
    if not frequent.isEmpty():
        found = found.unionByName(by_digest(frequent, w))
    return chosen.select("t", "h", "packed"), found


def dealt_run(ranges: dict[int, dict[bytes, set[bytes]]], run: int) -> pd.DataFrame:
    """A sorted run of each range, front-coded."""
    rows = [(part, run, front_coded([(s, b"".join(sorted(items[s]))) for s in sorted(items)])) for part, items in ranges.items()]
    return pd.DataFrame(rows, columns=["part", "run", "blob"])


def by_digest(texts: DataFrame, w: Window) -> DataFrame:
    """The spans of passages too frequent for one range: contexts, then windows, counted by
    their digests. One row per distinct context and window; no group is gathered."""

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (pdf.iloc[at:at + 256] for pdf in batches for at in range(0, len(pdf), 256))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in some(batches):
            out = []
            for h, blob, at in zip(pdf["h"], pdf["packed"], pdf["at"], strict=True):
                raw = zstandard.decompress(blob)
                for place in at:
                    a, near, far = int(place) >> 16, int(place) >> 8 & 255, int(place) & 255
                    if a >= far and a - near + w.length <= len(raw):
                        s = suffix(raw, a, near, far, w)
                        out.append((hashlib.md5(s).digest(), h, a, s))
            yield pd.DataFrame(out, columns=["c", "h", "a", "s"])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in some(batches):
            out = []
            for c, s in zip(pdf["c"], pdf["s"], strict=True):
                far = s[w.width]
                whole = s[w.longest:w.longest + far][::-1] + s[:w.longest]
                for near, length in zip(s[w.width + 1:], w.lengths, strict=True):
                    out += [(xxhash.xxh3_128_digest(whole[far - x:far - x + length]), length, c, x) for x in range(near, far + 1)]
            yield pd.DataFrame(out, columns=["w", "length", "c", "l"])

    all_places = write_table(texts.mapInPandas(contexts, "c binary, h binary, a int, s binary"), "contexts")
    mark = F.xxhash64("h", "a")
    distinct = all_places.groupBy("c").agg(F.min("s").alias("s"), (F.min(mark) != F.max(mark)).alias("many"))
    pieces = write_table(distinct.select("c", "s").mapInPandas(windows, "w binary, length int, c binary, l int"), "windows")
    twice = pieces.groupBy("w", "length").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("w", "length")
    own = pieces.join(twice, ["w", "length"]).select("c", "length", "l").unionByName(
        pieces.join(distinct.filter("many").select("c"), "c").select("c", "length", "l")).distinct()

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
            for h, a, length, x in zip(pdf["h"], pdf["a"], pdf["length"], pdf["l"], strict=True):
                found.setdefault((h, length), []).append((a - x, a - x + length))
            yield covered(found)

    return all_places.select("c", "h", "a").join(own, "c").mapInPandas(spans, "h binary, length int, spans binary")


def digest(text: str):
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


def copies(df: DataFrame, text: str, length: int, least_words: int) -> DataFrame:
    """(h) of the texts that stand in several rows and go whole."""
    long_enough = df.filter(F.octet_length(text) >= length)
    if least_words:
        long_enough = long_enough.filter(n_words(text) >= least_words)
    return long_enough.groupBy(digest(text).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")


def cut_texts(df: DataFrame, text: str, wanted: list[tuple[int, int]], bodies: bool = False, **how) -> DataFrame:
    """(h, and for the i-th of the (length, least words) that are wanted: gone, n, sha<i>, with ``bodies``
    body<i>) of the distinct texts that lose some bytes; texts that are copied whole may be among them."""
    texts, found = repeated_spans(df, text, tuple(sorted({length for length, _ in wanted})), **how)
    known = found.groupBy("h").agg(F.collect_list(F.struct("length", "spans")).alias("spans"))
    columns = {f"{c}{i}": kind for i in range(len(wanted)) for c, kind in (("gone", "long"), ("n", "long"), ("sha", "string"), ("body", "string"))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, blob, spans in zip(pdf["h"], pdf["packed"], pdf["spans"], strict=True):
                raw, row, any_gone = zstandard.decompress(blob), [h], 0
                for length, least_words in wanted:
                    body, gone, n = remaining(raw, [x["spans"] for x in spans if x["length"] == length], least_words)
                    row += [gone, n, hashlib.sha256(body).hexdigest(), body.decode(errors="ignore") if bodies else None]
                    any_gone += gone
                if any_gone:
                    out.append(row)
            yield pd.DataFrame(out, columns=["h", *columns])

    once = texts.select("h", "packed").join(known, "h").mapInPandas(run, ", ".join(["h binary", *(f"{c} {k}" for c, k in columns.items())]))
    return once.groupBy("h").agg(*[F.min(c).alias(c) for c in columns if bodies or c[:4] != "body"])  # a text once, not once per task


def remaining(raw: bytes, blobs_of, least_words: int = 0) -> tuple[bytes, int, int]:
    """(bytes kept, bytes removed, runs removed) of a text."""
    spans = union([tuple(x) for b in blobs_of for x in np.frombuffer(b, "<u4").reshape(-1, 2).tolist()])
    kept, at, n = [], 0, 0
    for s, e in spans:
        if not least_words or len(raw[s:e].split()) >= least_words:
            kept.append(raw[at:s])
            at, n = e, n + 1
    kept.append(raw[at:])
    body = b"".join(kept)
    return body, len(raw) - len(body), n


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least_words: int = 0,
            passages: tuple[int, int] | None = None, **how) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row; with ``passages`` (length, least
    words) also ``n_passages``, the runs that these would remove."""
    raw = text_or_empty(text).cast("binary")
    wanted = [(length, least_words), *[passages] * (passages is not None)]
    known = df.select(F.col(key), digest(text).alias("h"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    for i, x in enumerate(wanted):
        known = known.join(copies(df, text, *x).withColumn(f"copied{i}", F.lit(True)), "h", "left")
    known = known.join(cut_texts(df, text, wanted, **how), "h", "left")

    def told(i: int, whole, part, none):
        return F.when(F.col(f"copied{i}"), whole).otherwise(F.coalesce(F.col(part), none))

    return known.select(
        F.col(key), "n_bytes", told(0, F.col("n_bytes"), "gone0", F.lit(0)).alias("n_removed"),
        told(0, F.lit(1), "n0", F.lit(0)).cast("long").alias("n_spans"), told(0, F.sha2(F.lit(b""), 256), "sha0", F.col("whole")).alias("kept_sha256"),
        *[told(1, F.lit(1), "n1", F.lit(0)).cast("long").alias("n_passages")] * (passages is not None))


def clean(df: DataFrame, text: str = "text", length: int = LENGTH, least_words: int = 0, **how) -> DataFrame:
    """``df`` with the repeated bytes taken out of its texts; all rows and columns stay."""
    whole = copies(df, text, length, least_words).select(F.col("h").alias("__h"), F.lit(True).alias("__copied"))
    cut = cut_texts(df, text, [(length, least_words)], bodies=True, **how).select(F.col("h").alias("__h"), F.col("body0").alias("__body"))
    rows = df.withColumn("__h", digest(text)).join(cut.join(whole, "__h", "full_outer"), "__h", "left")
    body = F.when(F.col("__copied"), F.lit("")).otherwise(F.coalesce("__body", text))
    return rows.withColumn(text, body).select(*df.columns)
