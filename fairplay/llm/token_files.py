"""Token ids as Parquet list columns, and selective reads of them.

Documents are dealt by ranges of their key, sorted inside, encoded, and written
with one row each: key, place in the file's token stream (``offset``), ``n_tokens``
and ``ids``. Ids use dictionary encoding (the vocabulary fits one dictionary page)
or delta encoding; row-group and page sizes are parameters and the writer leaves
page indexes, so a reader that wants some keys, or only the metadata columns, skips
the rest of the ids.

The tokenizer drops ASCII white space before it splits (checked in tests against the
library on whole texts), so a text's ids are those of its white-space separated
words in a row. Words are encoded by the library, and those in use are remembered by
a worker, up to a bound.

Cases: null and empty texts hold the end id alone; repeated rows are written each,
rows of one key in the order of their text's hash; null keys come first; an empty
table gives an empty table; other columns do not matter. A text is written whole,
whatever its length.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fairplay.session import ensure_checkpoint_dir

KNOWN_WORDS, LONGEST = 200_000, 64  # words remembered by a worker, in two generations; longer ones are not
TOGETHER, SLICE = 4096, 6 << 20  # new words in one call; bytes of texts encoded together, or one text
#: Words of these characters alone are their own NFC form, lower-case letter by letter, and are cut into runs of
#: letters and of marks: A-Z, a-z, Latin letters up to U+017F but for U+0130, ASCII marks but for the apostrophe.
ODD = re.compile("[^A-Za-zÀ-ÖØ-öø-įı-ſ!-&(-/:-@\\[-`{-~]")
LETTERS = re.compile("[a-zß-öø-ſ]+")
#: What the tokenizer file has to do before its vocabulary for that to hold.
STEPS = (("Sequence", ["NFC", "Replace", "Lowercase"], ["\\s+"]),
         ("Sequence", ["Split", "ByteLevel"], ["'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"]))
_LOADED: dict[int, Words] = {}

ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def steps(part: dict | None, names: str) -> tuple:
    """(type, types of its steps, patterns) of a normalizer or pre-tokenizer."""
    inner = (part or {}).get(names) or []
    return (part or {}).get("type"), [x["type"] for x in inner], [x["pattern"]["Regex"] for x in inner if "Regex" in x.get("pattern", {})]


class Words:
    """Ids of texts as little-endian 32-bit bytes, word by word.

    New words are encoded by the library many at a time, with a special token between them that
    tells their ids apart. Where the file's steps are ``STEPS`` and its tokens tell the end of a
    run, words without odd characters skip the library's normalizer and pattern, which cost
    more than the vocabulary itself, and need nothing between them.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        described = json.loads(vocabulary)
        self.library = Tokenizer.from_str(vocabulary)
        added = described.get("added_tokens") or []
        special = next((x for x in added if x["special"] and not x["lstrip"] and not x["rstrip"]), None)
        self.between, self.cut = (special["content"], special["id"]) if special else (None, -1)
        self.added = re.compile(b"|".join(re.escape(x["content"].encode()) for x in added) or b"$^")
        self.plain, end = None, described["model"].get("end_of_word_suffix")
        self.ends = np.array([bool(end) and (self.library.id_to_token(i) or "").endswith(end) for i in range(self.library.get_vocab_size())])
        if end and (steps(described["normalizer"], "normalizers"), steps(described["pre_tokenizer"], "pretokenizers")) == STEPS:
            self.plain = Tokenizer.from_str(vocabulary)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def alone(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found, strict=True)}

    def together(self, words: list[bytes]) -> dict[bytes, bytes]:
        text = self.between.join(w.decode() for w in words)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.flatnonzero(ids == self.cut) * 4, ids.nbytes).tolist()
        if len(ends) != len(words):
            return self.alone(words)
        raw, starts = ids.tobytes(), [0, *(e + 4 for e in ends[:-1])]
        return {w: raw[a:b] for w, a, b in zip(words, starts, ends, strict=True)}

    def usual(self, words: list[bytes]) -> dict[bytes, bytes]:
        runs = LETTERS.sub(r" \g<0> ", b"\n".join(words).decode().lower())
        ids = np.array(self.plain.encode_batch_fast([runs], add_special_tokens=False)[0].ids, "<u4")
        places = np.flatnonzero(self.ends[ids])
        last = np.cumsum([len(x.split()) for x in runs.split("\n")])
        if not len(places) or last[-1] != len(places):
            return self.alone(words)
        raw, ends = ids.tobytes(), ((places[last - 1] + 1) * 4).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *ends], ends, strict=False)}

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        if not self.between:
            return self.alone(new)
        out: dict[bytes, bytes] = {}
        special, usual, odd = [], [], []
        for w in new:
            (special if self.added.search(w) else odd if self.plain is None or ODD.search(w.decode()) else usual).append(w)
        out |= self.alone(special)
        for words, how in ((usual, self.usual), (odd, self.together)):
            for at in range(0, len(words), TOGETHER):
                out |= how(words[at:at + TOGETHER])
        return out

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [w for w in words if w not in known]
        if not new:
            return [known[w] for w in words]
        known.update((w, older[w]) for w in new if w in older)
        found = self.learn([w for w in new if w and w not in known])
        rare = {w: found.pop(w) for w in [w for w in found if len(w) > LONGEST]}
        known.update(found)
        rare[b""] = b""
        return [known[w] if w in known else rare[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, place of each text's end); null is empty."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        ids = pa.array(self.of(words.dictionary.cast(pa.binary()).to_pylist()), pa.large_binary()).take(words.indices)
        places = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        of_text = split.offsets.to_numpy() - split.offsets[0].as_py()
        values = np.frombuffer(ids.buffers()[2], "<i4", int(places[-1]) // 4) if places[-1] else np.zeros(0, "<i4")
        return values, places[of_text][1:] // 4


def loaded(vocabulary: bytes) -> Words:
    """One tokenizer per worker and vocabulary."""
    name = zlib.crc32(vocabulary)
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Words(vocabulary.decode())
    return _LOADED[name]


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (column 1) have about ``SLICE`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def write(df: DataFrame, vocabulary_path: str, path: str, end_id: int, key: str = "doc_id", text: str = "text",
          encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10,
          compression: str = "snappy") -> None:
    """Writes (file, key, offset, n_tokens, ids) in ascending key order over the files."""
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(Path(vocabulary_path).read_bytes())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, offset = loaded(vocabulary.value), 0
        for batch in batches:
            for part in sliced(batch):
                values, ends = words.encode(part.column(1))
                values = np.insert(values, ends, end_id)
                ends = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(offset + ends[:-1]), pa.array(np.diff(ends)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                    names=[key, "offset", "n_tokens", "ids"])
                offset += int(ends[-1])

    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col(key).asc_nulls_first(), F.xxhash64("__t"))  # a key that many rows share is several ranges
    dealt = df.select(F.col(key), F.col(text).alias("__t")).repartitionByRange(files, *order).sortWithinPartitions(*order)
    encoded = dealt.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, offset long, n_tokens long, ids array<int>")
    (encoded.withColumn("file", F.spark_partition_id()).write
     .options(**ENCODINGS[encoding], **{"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes),
                                        "compression": compression})
     .parquet(path))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, offset, n_tokens) of the stored documents; the scan reads no ids."""
    return spark.read.parquet(path).drop("ids")


def documents(spark: SparkSession, path: str, low, high, key: str = "doc_id") -> DataFrame:
    """The stored rows whose key is from ``low`` to ``high``: files, row groups and, by the page
    indexes, pages outside are not read, as keys ascend over the files and inside them."""
    return spark.read.parquet(path).filter(F.col(key).between(low, high))


def read_back(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every stored document, from the files."""
    stored = spark.read.parquet(path)
    totals = stored.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # a row per file; reads no ids
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    places = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(np.ascontiguousarray(values[a:b], "<i4")) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)),
                 pa.array(np.array(crc, np.int64))], names=["file", key, "offset", "n_tokens", "ids_crc32"])

    kind = dict(stored.dtypes)[key]
    read = stored.select("file", key, "offset", "ids").mapInArrow(
        run, f"file int, {key} {kind}, offset long, n_tokens long, ids_crc32 long")
    return read.join(places, "file").select(key, (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
