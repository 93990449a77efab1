"""SentencePiece encoding and decoding with byte offsets into the original text.

Normalisation is done here, by the rule of the compiled character map stored in the
model: at every position the longest prefix in the map's double-array trie is
replaced, otherwise one character is kept; every byte written remembers the byte of
the original text it came from. White space is escaped and the dummy prefix set as
the model asks, also with their sources. Pieces then tile the normalised bytes, so
each piece projects to a span of original bytes through that record. Byte pieces of
one character have that character's bytes one by one.

Segmentation works on chunks (escaped spaces, then the rest up to the next space).
BPE only builds pieces of the vocabulary; where no piece has a space mark after
another character (checked when the model is loaded), no merge crosses a chunk's
start, so chunks are encoded once each by the library and remembered, and a text's
ids are those of its chunks in a row. A model without that property, or a text that
holds the mark itself, is encoded whole. A worker remembers at most ``CACHE`` chunks and then starts anew, which
bounds memory and changes no result.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows
are encoded each; texts of any length are encoded whole; an empty table gives an
empty table; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairplay.llm.common import carried

CACHE, LONGEST = 150_000, 64
ROWS = 256  # rows of a result frame: bounds what a worker holds
SPACE = "▁"
PREFIX = len(SPACE.encode())
CHUNK = re.compile(" +[^ ]*")
_LOADED: dict[str, Codec] = {}


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, message[at:at + size]
            at += size


class CharMap:
    """The compiled character map: a double-array trie of keys, and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.replacements = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that starts at ``at``."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(units[0])
        for i in range(at, len(text)):
            byte = text[i]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[start:self.replacements.index(b"\0", start)]
        return found

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 1 << 9) >> 6)


class Normalizer:
    """Normalised bytes with, for each byte and the end, its place in the original."""

    def __init__(self, model: bytes):
        spec = dict(fields(next((v for n, v in fields(model) if n == 3), b"")))
        self.charmap = CharMap(spec.get(2, b""))
        self.prefix, self.trim, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.mark = SPACE.encode() if self.escape else b" "

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        raw = text.encode()
        if not raw:
            return b"", [0]
        if self.plain and b" " not in raw:
            mark = self.mark if self.prefix else b""
            return mark + raw, [0] * len(mark) + list(range(len(raw) + 1))
        out, source, at, skipping = bytearray(), [], 0, self.trim
        while at < len(raw):
            found = self.charmap.longest(raw, at)
            if found is None:
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = raw[at:at + n]
            else:
                n, new = found
            if skipping:
                new = new.lstrip(b" ")
            if new and self.prefix and not out:
                out += self.mark
                source += [at] * len(self.mark)
            for i, byte in enumerate(new):
                put = self.mark if byte == 32 else bytes([byte])
                out += put
                source += [at if found else at + i] * len(put)
            if new:
                skipping = self.trim and new.endswith(b" ")
            at += n
        end = len(raw)
        while self.trim and out.endswith(self.mark):
            end = source[-len(self.mark)]
            del out[-len(self.mark):], source[-len(self.mark):]
        return bytes(out), [*source, end]

    @property
    def plain(self) -> bool:
        """Whether spaces are all that changes."""
        return not self.charmap.units and not self.trim


class Codec:
    """The library's segmentation with this module's normalisation and offsets."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalizer = Normalizer(model)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.lengths = [1 if self.library.is_byte(i) else 0 if self.library.is_unknown(i) else len(p.encode())
                        for i, p in enumerate(names)]
        self.chunked = (self.normalizer.plain and self.normalizer.prefix and self.normalizer.escape
                        and not any(SPACE in p.lstrip(SPACE) for p in names))
        self.known: dict[str, tuple] = {}

    def spans(self, text: str, ids: list[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Original byte spans of the pieces; -1: begins in the dummy prefix."""
        lengths = [self.lengths[i] for i in ids]
        if self.chunked and " " not in text and SPACE not in text and all(lengths):
            # the prefix, then the text as it is: a place is its place less the prefix
            ends = [e - PREFIX for e in accumulate(lengths)]
            if ends[-1] != len(text.encode()):
                raise ValueError("pieces do not tile the normalised text")
            return (-1, *ends[:-1]), tuple(ends)
        normal, source = self.normalizer(text)
        if not all(lengths):  # an unknown piece has its surface's length
            lengths = [n or len(p.encode()) for n, p in zip(lengths, self.library.encode(text, out_type=str), strict=True)]
        ends, at = [], 0
        for n in lengths:
            at += n
            ends.append(at)
        if at != len(normal):
            raise ValueError("pieces do not tile the normalised text")
        starts = [source[e - n] for e, n in zip(ends, lengths, strict=True)]
        if starts and self.normalizer.prefix:
            starts[0] = -1
        return tuple(starts), tuple(source[e] for e in ends)

    def chunks(self, text: str) -> list[str]:
        """What follows the (dummy or real) space of each chunk; a chunk's further spaces lead it."""
        if not text:
            return []
        return [c[1:] for c in CHUNK.findall(" " + text)] if self.chunked and SPACE not in text else [text]

    def encode(self, text: str) -> list[tuple]:
        """Per chunk (ids, their decimal text, starts, ends), offsets within the chunk."""
        parts, known = self.chunks(text), self.known
        if len(known) > CACHE:
            known.clear()
        new = [p for p in dict.fromkeys(parts) if p not in known]
        once = {}
        for p, ids in zip(new, self.library.encode(new, num_threads=1) if new else [], strict=True):
            found = (tuple(ids), ",".join(map(str, ids)), *self.spans(p, ids)) if p else self.lone()
            (known if len(p) <= LONGEST else once)[p] = found
        return [known[p] if p in known else once[p] for p in parts] if once else list(map(known.__getitem__, parts))

    def lone(self) -> tuple:
        """A space with nothing after it, which the library does not take alone."""
        ids = self.library.encode("a ")[len(self.library.encode("a")):]
        return tuple(ids), ",".join(map(str, ids)), (-1,) * len(ids), (0,) * len(ids)

    def joined(self, text: str) -> tuple[list[int], str, list[int], list[int]]:
        """(ids, their decimal text, starts, ends) of a text, offsets in its UTF-8 bytes."""
        ids, names, starts, ends, at = [], [], [], [], 0
        for part, (i, name, s, e) in zip(self.chunks(text), self.encode(text), strict=True):
            ids += i
            names.append(name)
            starts += [max(0, at + x) for x in s]
            ends += [at + x for x in e]
            at += len(part.encode()) + 1
        return ids, ",".join(names), starts, ends

    def digest(self, text: str) -> tuple[int, str, str, int]:
        """(ids, SHA-256 of the ids, SHA-256 of the decoded text, original bytes covered)."""
        parts = self.encode(text)
        ids = list(chain.from_iterable(p[0] for p in parts))
        covered = sum(p[3][-1] for p in parts if p[3]) + max(0, len(parts) - 1)
        return (len(ids), hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest(),
                hashlib.sha256(self.library.decode(ids).encode()).hexdigest(), covered)


def loaded(model: bytes) -> Codec:
    """One codec per worker and model."""
    name = hashlib.md5(model).hexdigest()
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Codec(model)
    return _LOADED[name]


def _apply(df: DataFrame, key: str, text: str, model_path: str, columns: str,
           each: Callable[[Codec, str], tuple]) -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())  # a vocabulary of fixed size
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = loaded(model.value)
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.iloc[at:at + ROWS]
                rows = [each(codec, "" if t is None else t) for t in part["t"]]
                yield pd.DataFrame({"k": part["k"].reset_index(drop=True)} | {n: [r[i] for r in rows] for i, n in enumerate(names)})

    kind = dict(df.dtypes)[key]
    slim = df.select(F.col(key).cast(carried(kind)).alias("k"), F.col(text).alias("t"))
    return slim.mapInPandas(run, f"k {carried(kind)}, {columns}").select(F.col("k").cast(kind).alias(key), *names)


def encode(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, starts, ends): ids and the UTF-8 byte span of each piece in the original."""
    def each(codec: Codec, t: str) -> tuple:
        ids, _, starts, ends = codec.joined(t)
        return ids, starts, ends

    return _apply(df, key, text, model_path, "ids array<int>, starts array<int>, ends array<int>", each)


def decode(df: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the library's decoded text of each id list; null ids give the empty text."""
    def each(codec: Codec, i) -> tuple:
        return (codec.library.decode([int(x) for x in i]),)

    return _apply(df, key, ids, model_path, "text string", each)


def round_trip(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_covered) without shipping the id lists."""
    return _apply(df, key, text, model_path,
                  "n_tokens long, ids_sha256 string, decoded_sha256 string, n_covered long", Codec.digest)
