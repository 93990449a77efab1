"""The registered queries of the operators (the contract's columns) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairplay.llm import (
    exact_dedup, html_text, importance, merkle, mixing, pieces, ppm, quality, sharding, simhash, suffix_dedup, token_files, topk)
from fairplay.llm.common import n_words, read, text_or_empty, utf8_size

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7, counts at most one apart (law ``rows``)."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (utf8_size("text") + 1).alias("size"),
        F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"))
    return sharding.shard(docs, "doc_id", ["text_crc32", "size"], shards=8, seed=4).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size"))
    return mixing.repetitions(docs, seed=7).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (3-word shingles, 2 bits)."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words_per_shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every document under the byte-context trie, and the word base."""
    return ppm.score(read(spark, sf_dir, "documents"))


@query
def op6_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return pieces.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as Parquet and read back."""
    path = token_files.scratch(spark, "tokens")
    token_files.write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return token_files.read_back(spark, path)


@query
def op3_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base rule and verdict of every document."""
    return quality.judged(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest inner products of every query vector (ids divisible by 100)."""
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of every document's bytes, 400 at a time, is removed; ``n_passages``: its
    repeated passages of over 50 words, which may be shorter than that (225 bytes or more)."""
    return suffix_dedup.removed(read(spark, sf_dir, "documents"), passages=(225, 51))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in the draw towards the benchmark's words."""
    found = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, size and verdict of every document; texts are equal up to white space."""
    found = exact_dedup.Index(read(spark, sf_dir, "documents")).classes()
    return found.select(F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root of its tampered version."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changes={"n_chars": F.col("n_chars") + 1}, when=tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
