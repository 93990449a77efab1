"""Language-model scoring by prediction by partial matching (PPM) over bytes.

Text of the model: the words of the document, A-Z lower-cased, one space between
them, and an end byte. The trie holds, for every context of up to ``ORDER`` bytes
in the training documents, the counts of the bytes that follow. A byte seen n times
in a context of r counts costs (n - 1/2) / r; for a byte it has not seen, the coder
escapes to the next shorter context at (d / 2) / r, where d bytes have been seen
(escape estimate D), and there the bytes of the longer context are excluded from n, r and
d. Below order 0 the bytes never seen are equally likely. The probabilities of a
context sum to one.

On Spark: one pass over the documents cuts them into blocks of some megabytes, and
writes for each block its (compressed) words and its distinct strings (context and
byte) and words with training counts, dealt to 512 buckets, as a table in the shared
folder. Strings whose last two context bytes agree share a bucket, so all their
suffixes down to order 2 are at hand there; the order-1 table has at most 65,536
counts, the only thing every task gets. Counts are summed per bucket (first where
they are read, then by merges of at most 256 rows), each bucket works out the cost of
each of its strings, and the costs go back to the blocks that asked for them by a
merge join that holds the model of one bucket at a time and streams the blocks past
it; buckets are salted so that a frequent pair of bytes is not one task. Each block
then adds up its documents. Text is never shuffled except as whole compressed blocks.

Cases: null and empty texts are one end byte and one end token; a null id counts
as the empty text in the training rule; repeated rows count and score each; an
empty table gives an empty table; with no training documents all bytes cost 1/256.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairplay.llm.common import carried, write_table

ORDER = 5
PAD = b"\n" * ORDER
SHIFT = np.uint64(64 - 8 * (ORDER + 1))
LOW = np.uint64((1 << int(SHIFT)) - 1)  # room for a document's place beside a string
SEGMENT = 1 << 22
BUCKETS, SALTS, FAN_IN = 512, 8, 256
END = b" "  # the end token among words, which hold no spaces
COUNTS = "bucket int, part long, strings binary, n binary, words binary, word_n binary"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and where each begins (with the end)."""
    new = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.array([], np.int64)
    return sorted_keys[new], np.append(new, len(sorted_keys))


def segments(bodies: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, its sorted strings shifted left with the document's place after the
    first in the low bits), some megabytes at a time."""
    first = 0
    while first < len(bodies):
        last, size = first, 0
        while last < len(bodies) and last - first < int(LOW) and (last == first or size + len(bodies[last]) <= SEGMENT):
            size += len(bodies[last])
            last += 1
        flat = b"".join(x for b in bodies[first:last] for x in (PAD, b)) + b"\0" * 8
        windows = np.ndarray((len(flat) - 7,), ">u8", flat, strides=(1,))
        lengths = np.array([len(b) for b in bodies[first:last]], np.int64)
        begin = np.cumsum(lengths + ORDER) - lengths - ORDER
        if last - first > 1:
            doc = np.repeat(np.arange(last - first), lengths)
            at = np.arange(len(doc)) + (begin - (np.cumsum(lengths) - lengths))[doc]
            s = (windows[at].astype(np.uint64) & ~LOW) | doc.astype(np.uint64)
            s.sort()
            yield first, s
        else:
            for cut in range(0, size, SEGMENT):  # one long document in pieces
                s = windows[cut:min(size, cut + SEGMENT)].astype(np.uint64) & ~LOW
                s.sort()
                yield first, s
        first = last


def bucket_of(strings: np.ndarray) -> np.ndarray:
    return (((strings >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) & np.uint64(0xFFFF)) >> np.uint64(7)


def dealt(strings: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket order of the strings and words, and the bounds of the buckets in it."""
    b = bucket_of(strings).astype(np.int64)
    w = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS
    edges = np.arange(BUCKETS + 1)
    by, wy = np.argsort(b, kind="stable"), np.argsort(w, kind="stable")
    return by, np.searchsorted(b[by], edges), wy, np.searchsorted(w[wy], edges)


def distinct_strings(bodies: list[bytes]) -> np.ndarray:
    found = [runs(s >> SHIFT)[0] for _, s in segments(bodies)]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.array([], np.uint64)


class Block:
    """Documents gathered for a block: their bodies, and words with training counts."""

    def __init__(self):
        self.keys, self.train, self.bodies, self.size = [], [], [], 0
        self.words: dict[bytes, int] = {END: 0}

    def add(self, key, text: str | None, train: bool) -> None:
        w = tokens(text)
        count, step = self.words, int(train)
        for x in w:
            count[x] = count.get(x, 0) + step
        count[END] += step
        self.keys.append(None if pd.isna(key) else key)
        self.train.append(bool(train))
        self.bodies.append(b" ".join(w) + b"\n")
        self.size += len(self.bodies[-1])

    def rows(self, block: int) -> pd.DataFrame:
        """Its documents (bucket -1), and a row per bucket that it asks: strings in the first
        ``BUCKETS``, words in as many more."""
        strings, train = distinct_strings(self.bodies), np.array(self.train, bool)
        n = np.zeros(len(strings), np.int64)
        for first, s in segments(self.bodies):
            own, at = runs(s >> SHIFT)
            seen = np.concatenate([[0], np.cumsum(train[first + (s & LOW).astype(np.int64)])])
            n[np.searchsorted(strings, own)] += seen[at[1:]] - seen[at[:-1]]
        names, wn = list(self.words), np.fromiter(self.words.values(), np.int64, len(self.words))
        by, cut, wy, wcut = dealt(strings, names)
        rows = [(block, -1, self.keys, self.train, zstandard.compress(b"".join(self.bodies), 6), None, None, None, None)]
        for b in range(BUCKETS):
            s, w = by[cut[b]:cut[b + 1]], wy[wcut[b]:wcut[b + 1]]
            if len(s):
                rows.append((block, b, None, None, None, write_strings(strings[s]), packed(n[s]), None, None))
            if len(w):
                rows.append((block, BUCKETS + b, None, None, None, None, None, write_words([names[i] for i in w]), packed(wn[w])))
        return pd.DataFrame(rows, columns=["block", "bucket", "keys", "train", "docs", "strings", "n", "words", "word_n"])


def packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def unpacked(blob: bytes | None, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob) if blob else b"", kind)


def write_strings(strings: np.ndarray) -> bytes:
    """Ascending strings as differences."""
    return packed(np.diff(strings, prepend=np.uint64(0)))


def read_strings(blob: bytes | None) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64)


def write_words(words) -> bytes:
    return zstandard.compress(b"\n".join(words), 1)


def read_words(blob: bytes | None) -> list[bytes]:
    text = zstandard.decompress(blob) if blob else b""
    return text.split(b"\n") if text else []


def merged(bucket: int, part: int, rows: pd.DataFrame) -> tuple:
    """One row of counts from several of a bucket."""
    if bucket >= BUCKETS:
        count: Counter[bytes] = Counter()
        for blob, n in zip(rows["words"], rows["word_n"], strict=True):
            count.update(dict(zip(read_words(blob), unpacked(n, np.int64).tolist(), strict=True)))
        return bucket, part, None, None, write_words(count), packed(np.fromiter(count.values(), np.int64, len(count)))
    strings, back = np.unique(np.concatenate([read_strings(s) for s in rows["strings"]]), return_inverse=True)
    n = np.bincount(back, np.concatenate([unpacked(x, np.int64) for x in rows["n"]]), len(strings)).astype(np.int64)
    return bucket, part, write_strings(strings), packed(n), None, None


def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side sums: the rows that a task reads, merged by bucket every 24 MB."""
    held: list[pd.DataFrame] = []
    size = 0

    def flush() -> pd.DataFrame:
        rows = pd.concat(held)
        out = [merged(b, int(g["block"].iloc[0]), g) for b, g in rows.groupby("bucket")]
        held.clear()
        return pd.DataFrame(out, columns=["bucket", "part", "strings", "n", "words", "word_n"])

    for pdf in batches:
        held.append(pdf)
        size += sum(len(x or b"") for c in ("strings", "words") for x in pdf[c])
        if size > 24 << 20:  # packed
            yield flush()
            size = 0
    if held:
        yield flush()


def merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([merged(int(pdf["bucket"].iloc[0]), int(pdf["part"].iloc[0]), pdf)],
                        columns=["bucket", "part", "strings", "n", "words", "word_n"])


def costs(strings: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each distinct string (context bytes, then the byte), sorted.

    ``n``: training counts (0: asked for only). ``pairs``: the 256 x 256 counts of a byte
    after a byte. All strings that share their last two context bytes must be present.
    Deepest order first; ``at`` follows each string to its suffix at the present order.
    """
    out, waiting = np.zeros(len(strings)), np.ones(len(strings), bool)
    level, at = strings, np.arange(len(strings))
    taken, gone = np.zeros(len(strings)), np.zeros(len(strings))
    for k in range(ORDER, -1, -1):
        if k > 1:
            contexts, begin = runs(level >> np.uint64(8))
            ctx = np.repeat(np.arange(len(contexts)), np.diff(begin))
            total, distinct = np.bincount(ctx, n, len(contexts))[ctx], np.bincount(ctx, n > 0, len(contexts))[ctx]
        elif k == 1:
            b, s = (level >> np.uint64(8)).astype(np.int64), (level & np.uint64(255)).astype(np.int64)
            n, total, distinct = pairs[b, s], pairs.sum(1)[b], (pairs > 0).sum(1)[b]
        else:
            n = pairs.sum(0)
            total, distinct = np.full(256, n.sum()), np.full(256, (n > 0).sum())
        _code(out, waiting, n[at], total[at], distinct[at], taken, gone)
        if k == 0:
            break
        # what this context has seen is excluded from the next shorter one
        if k > 1:
            shorter, back = np.unique(level & np.uint64((1 << (8 * k)) - 1), return_inverse=True)
            short_n = np.bincount(back, n, len(shorter)) if k > 2 else pairs[
                (shorter >> np.uint64(8)).astype(np.int64), (shorter & np.uint64(255)).astype(np.int64)]
            taken = np.bincount(ctx, np.where(n > 0, short_n[back], 0), len(contexts))[ctx][at]
            gone = distinct[at]
            level, n, at = shorter, short_n, back[at]
        else:
            known = pairs > 0
            taken, gone, at = (known * pairs.sum(0)).sum(1)[b][at], distinct[at], s[at]
    out[waiting] -= math.log10(max(1, 256 - int((pairs.sum(0) > 0).sum())))
    return out


def _code(out, waiting, n, total, distinct, taken, gone) -> None:
    """Adds the cost at one order: of the byte, where this context knows it, else of the escape."""
    room, fresh = total - taken, distinct - gone
    hit = waiting & (n > 0)
    out[hit] += np.log10((n[hit] - 0.5) / room[hit])
    miss = waiting & (n == 0) & (fresh > 0)
    out[miss] += np.log10(fresh[miss] / 2 / room[miss])
    waiting &= n == 0


def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge join: sorted rows, a bucket's model before the blocks that ask it."""
    model = None
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            if r.block < 0:
                model = ((read_strings(r.strings), unpacked(r.n, np.float64)) if r.bucket < BUCKETS
                         else dict(zip(read_words(r.words), unpacked(r.word_n, np.int64).tolist(), strict=True)))
            elif r.bucket < BUCKETS:
                rows.append((r.block, r.bucket, packed(model[1][np.searchsorted(model[0], read_strings(r.strings))])))
            else:
                rows.append((r.block, r.bucket, packed(np.array([model[w] for w in read_words(r.words)], np.int64))))
        if rows:
            yield pd.DataFrame(rows, columns=["block", "bucket", "values"])


def score(df: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 2, folds: int = 7,
          block_bytes: int = 16_000_000) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Documents whose crc32(key as text) mod ``folds`` is ``fold`` are held out. base: add-one
    unigram words. ``block_bytes`` sets only how the work is cut.
    """
    kind = dict(df.dtypes)[key]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block = TaskContext.get().partitionId() << 32, Block()
        for pdf in batches:
            for k, t, x in zip(pdf["k"], pdf["t"], pdf["train"], strict=True):
                block.add(k, t, x)
                if block.size > block_bytes:
                    yield block.rows(at)
                    at, block = at + 1, Block()
        if block.keys:
            yield block.rows(at)

    name = F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")
    docs = df.select(F.col(key).cast(carried(kind)).alias("k"), F.col(text).alias("t"), (F.crc32(name) % folds != fold).alias("train"))
    blocks = write_table(docs.mapInPandas(
        cut, f"block long, bucket int, keys array<{carried(kind)}>, train array<boolean>, docs binary, strings binary, n binary, "
        "words binary, word_n binary"), "ppm-blocks")
    asked = blocks.filter("bucket >= 0").select("block", "bucket", "strings", "n", "words", "word_n")
    sums = asked.mapInPandas(combine, COUNTS)
    parts = blocks.filter("bucket < 0").count()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        sums = sums.groupBy("bucket", F.pmod(F.xxhash64("part"), F.lit(parts)).alias("to")).applyInPandas(merge_group, COUNTS)
    counts = write_table(sums.groupBy("bucket").applyInPandas(merge_group, COUNTS), "ppm-counts")

    def statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                two = (read_strings(r.strings) & np.uint64(0xFFFF)).astype(np.int64)
                n = np.bincount(two, unpacked(r.n, np.int64), 1 << 16).astype(np.int64)
                wn = unpacked(r.word_n, np.int64)
                own = np.flatnonzero(n)
                yield pd.DataFrame({"p": [*own, -1, -2], "n": [*n[own], wn.sum(), (wn > 0).sum()]})

    pairs, n_train, vocabulary = np.zeros((256, 256), np.int64), 0, 0
    for p, n in counts.mapInPandas(statistics, "p int, n long").groupBy("p").agg(F.sum("n")).collect():  # 65,538 rows at most
        if p >= 0:
            pairs[p >> 8, p & 255] = n
        elif p == -1:
            n_train = n
        else:
            vocabulary = n

    def price(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["n"] = [s and packed(costs(read_strings(s), unpacked(n, np.int64), pairs)) for s, n in zip(pdf["strings"], pdf["n"], strict=True)]
            yield pdf

    # strings of a frequent pair of bytes are many, so their buckets are salted; words are dealt evenly
    salts = F.when(F.col("bucket") < BUCKETS, SALTS).otherwise(1)
    model = (counts.mapInPandas(price, COUNTS).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
             .select(F.lit(-1).cast("long").alias("block"), "bucket", "strings", "n", "words", "word_n", "salt"))
    salted = asked.withColumn("n", F.lit(None).cast("binary")).withColumn("word_n", F.lit(None).cast("binary")).withColumn(
        "salt", F.pmod(F.xxhash64("block"), salts).cast("int"))
    answers = (model.unionByName(salted).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "block")
               .select("block", "bucket", "strings", "n", "words", "word_n")
               .mapInPandas(answer, "block long, bucket int, values binary"))
    unit = math.log10(n_train + vocabulary + 1)

    def add_up(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        bodies = [b + b"\n" for b in zstandard.decompress(block["docs"].iloc[0]).split(b"\n")[:-1]]
        strings, words = distinct_strings(bodies), {END: None}
        for b in bodies:
            words.update(dict.fromkeys(b.split()))
        names = list(words)
        by, _, wy, _ = dealt(strings, names)
        found = found.sort_values("bucket")
        of_words = found["bucket"] >= BUCKETS
        cost, count = np.empty(len(strings)), np.empty(len(names), np.int64)
        cost[by] = np.concatenate([unpacked(c, np.float64) for c in found["values"][~of_words]])
        count[wy] = np.concatenate([unpacked(c, np.int64) for c in found["values"][of_words]])
        total = np.zeros(len(bodies))
        for first, s in segments(bodies):
            own, at = runs(s >> SHIFT)
            part = np.bincount((s & LOW).astype(np.int64), np.repeat(cost[np.searchsorted(strings, own)], np.diff(at)))
            total[first:first + len(part)] += part
        logs = dict(zip(names, (np.log10(count + 1) - unit).tolist(), strict=True))
        unseen = {w for w, c in zip(names, count.tolist(), strict=True) if not c}
        n_tokens, base, known = [], [], []
        for b in bodies:
            w = b.split()
            n_tokens.append(len(w) + 1)
            base.append(math.fsum(map(logs.__getitem__, w)) + logs[END])
            known.append(len(w) + (END not in unseen) - (sum(map(unseen.__contains__, w)) if unseen else 0))
        return pd.DataFrame({"row": pd.Series(list(block["keys"].iloc[0]), dtype="object"), "held_out": ~np.array(block["train"].iloc[0], bool),
                             "n_tokens": n_tokens, "n_known": known, "base_score": base, "score": total})

    return (blocks.filter("bucket < 0").select("block", "keys", "train", "docs").groupBy("block").cogroup(answers.groupBy("block"))
            .applyInPandas(add_up, f"row {carried(kind)}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
            .select(F.col("row").cast(kind).alias(key), "held_out", "n_tokens", "n_known",
                    F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score"))
