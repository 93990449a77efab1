"""The corpus pipeline: five stages over ``documents``, each written and read again.

Quality rules drop what the label model rejects; near-duplicates of a document that
stays go; passages of over 50 words that repeat between or inside the remaining documents
are cut from their texts; sources are mixed to their target weights (a document may go, stay
or stand twice); the last stage encodes the texts and returns digests of their ids.

All stages but the last return the columns of ``documents`` (with ``text`` changed by
the third). Cases are those of the operators; the stages add none: every row of a
stage's input is judged, whatever its nulls, ties or extra columns, and empty input
gives empty output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fairplay.llm import mixing, pieces, quality, simhash, suffix_dedup
from fairplay.llm.common import write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose posterior quality is one half or more."""
    return quality.keep(docs)


#: A passage is a repeated run of bytes with so many words, and no shorter than so many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 225


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by fingerprints at most 2 bits apart (3-word
    shingles), the one with the smallest id."""
    return simhash.keep_one(docs, words_per_shingle=3, max_bits=2)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words that stand twice or more."""
    return suffix_dedup.clean(docs, length=PASSAGE_BYTES, least_words=PASSAGE_WORDS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 150% of all words over the sources."""
    return mixing.mix(docs, seed=7)


def sentencepiece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_covered) of every row."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("source mixing", source_mixing),
    ("SentencePiece", sentencepiece_codec),
]
#: The stages' byte strings, tokenizer ids and fingerprints are beyond SQL; the tests
#: hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
