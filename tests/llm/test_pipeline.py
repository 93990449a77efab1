"""The pipeline against a brute-force version of its deciding stages, and SQL twins."""

from collections import Counter

import pytest

import corpus_pipeline
from fairplay.llm.oracle import SQL
from fairplay.llm.queries import QUERIES
from tests.conftest import SF_CHECK
from tests.llm import brute


def test_stages(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        out = corpus_pipeline.write_table(stage(spark, docs, edge_dir), "test")
        rows = out.collect()
        if name != "SentencePiece":
            assert out.columns == docs.columns
        if name == "quality rules":
            assert all(not brute.measures(r["text"])[5] for r in rows)
        if name == "SimHash near-dedup":
            assert len(rows) == len(set(brute.groups([brute.simhash(t) for _, t, _ in before])))
        if name == "suffix-array dedup":
            want = Counter((i, k.decode(errors="ignore")) for (i, _, _), (_, _, _, k) in zip(before, brute.repeats(
                [t for _, t, _ in before], corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)))
            assert Counter((r["doc_id"], r["text"]) for r in rows) == want
        if name == "source mixing":
            assert max(Counter(r["doc_id"] for r in rows if r["doc_id"] is not None).values()) <= 2
        docs = out
    want = Counter((i, *w) for (i, _, _), w in zip(before, brute.sentencepiece_rows([t for _, t, _ in before])))
    assert Counter(tuple(r)[:4] for r in rows) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, edge_dir).collect()) == Counter(tuple(r) for r in rows)


def test_pipeline_on_empty_table(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_clean_documents_pass_quality(spark):
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{SF_CHECK}/documents.parquet"), SF_CHECK).collect()}
    good = [r["doc_id"] for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").filter("quality = 1").collect()]
    bad = [r["doc_id"] for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").filter("quality = 0").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    clean = [i for i in good if not brute.measures(texts[i])[5]]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    assert sum(i in kept for i in bad) <= 0.2 * len(bad)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, duck, name):
    from fairplay.plans.verify import _rows

    assert _rows(QUERIES[name](spark, SF_CHECK).toPandas()) == _rows(duck.execute(SQL[name]).df())


