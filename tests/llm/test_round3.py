"""Importance resampling, exact dedup and the manifest, against brute force and on rarer paths."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fairplay.llm import exact_dedup, importance, merkle, topk
from fairplay.llm.queries import QUERIES
from tests.llm import brute


def rows_of(spark, path, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{path}/{table}.parquet").select(*columns).collect()]


def unranked(rows):
    return Counter(r[:4] for r in rows)


def test_importance_query(spark, edge_dir, docs):
    got = [tuple(r) for r in QUERIES["op11_importance_resampling"](spark, edge_dir).collect()]
    want = brute.importance([d[:2] for d in docs], [t for (t,) in rows_of(spark, edge_dir, "benchmark", "text")])
    assert Counter(got) == Counter(want)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, sum(r[4] is not None for r in want) + 1))


@pytest.mark.parametrize("longest, buckets", [(2, 97), (3, 10_000)])
def test_runs_of_several_words(spark, edge_dir, docs, longest, buckets):
    df, target = (spark.read.parquet(f"{edge_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = importance.resample(df, target, longest=longest, buckets=buckets, seed=5, percent=40, least_words=3)
    got = [tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want = brute.importance([d[:2] for d in docs], [t for (t,) in rows_of(spark, edge_dir, "benchmark", "text")], longest, buckets, 5, 40, 3)
    assert Counter(got) == Counter(want)


def test_drawn_rows_keep_their_columns(spark, edge_dir):
    df, target = (spark.read.parquet(f"{edge_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    drawn = importance.draw(df, target, percent=50)
    ranked = importance.resample(df, target, percent=50).filter("rank is not null")
    assert drawn.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(drawn.select("doc_id").collect(), key=key) == sorted(ranked.select("doc_id").collect(), key=key)


def test_importance_on_one_hot_row(spark):
    """A third of the rows are one row: its ranks are all different."""
    rows = [(7, "hot words " * 30)] * 200 + [(i, f"word{i % 9} other " * (i % 40)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    target = spark.createDataFrame([("hot words",)], "text string")
    got = [tuple(r) for r in importance.resample(df, target, percent=60).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert Counter(got) == Counter(brute.importance(rows, ["hot words"], percent=60))


def test_exact_query(spark, edge_dir, docs):
    got = [tuple(r) for r in QUERIES["op12_exact_dedup"](spark, edge_dir).collect()]
    assert Counter(got) == Counter(brute.exact([d[:2] for d in docs]))


@pytest.mark.parametrize("capacity, bits", [(1, 64), (3, 5), (2, 1), (20, 64)])
def test_index_splits_and_chains(spark, edge_dir, docs, capacity, bits):
    index = exact_dedup.Index(spark.read.parquet(f"{edge_dir}/documents.parquet"), capacity=capacity, bits=bits)
    got = index.classes().select("key", "keep_key", "n", F.col("row") == F.col("keep_row"), F.lower(F.hex("sha")))
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute.exact([d[:2] for d in docs]))
    slots = index.slots.collect()
    for r in slots:  # a bucket's slots share its leading bits; buckets are full to capacity unless they are one key
        assert r["slot"] >> (r["global_depth"] - r["depth"]) == r["bucket"] >> (r["global_depth"] - r["depth"])
        assert r["n"] <= capacity or bits < 64
    held = Counter(r["bucket"] for r in index.postings.select("bucket", "h").distinct().collect())
    assert held == {r["bucket"]: r["n"] for r in slots}
    if bits == 64:
        assert max(index.postings.select("link").collect())[0] == 0
    else:
        assert max(index.postings.select("link").collect())[0] > 0


def test_index_files_hold_ranges_of_keys(spark, edge_dir):
    index = exact_dedup.Index(spark.read.parquet(f"{edge_dir}/documents.parquet"), capacity=4)
    ranges = index.postings.groupBy(F.input_file_name()).agg(F.min("bucket"), F.max("bucket")).collect()
    ends = sorted((r[1], r[2]) for r in ranges)
    assert len(ends) > 1 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_one_row_of_each_text_stays(spark, edge_dir, docs):
    df = spark.read.parquet(f"{edge_dir}/documents.parquet")
    kept = exact_dedup.keep(df)
    assert kept.columns == df.columns
    want = Counter(i for (i, *_), (_, _, _, stays, _) in zip(docs, brute.exact([d[:2] for d in docs])) if stays)
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_exact_dedup_of_one_hot_text(spark):
    rows = [(i, " hot\ttext " if i % 3 == 0 else f"text {i % 50}") for i in range(600)]
    got = exact_dedup.Index(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), capacity=10).classes()
    got = got.select("key", "keep_key", "n", F.col("row") == F.col("keep_row"), F.lower(F.hex("sha")))
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute.exact(rows))


def test_exact_dedup_runs_no_python(spark, edge_dir):
    df = QUERIES["op12_exact_dedup"](spark, edge_dir)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def test_manifest_query(spark, edge_dir):
    got = [tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, edge_dir).collect()]
    assert Counter(got) == Counter(brute.merkle(rows_of(spark, edge_dir, "documents", *COLUMNS)))


@pytest.mark.parametrize("arity, levels, groups, n", [(2, 1, 3, 40), (2, 3, 1, 33), (3, 1, 7, 90), (3, 2, 2, 28), (4, 1, 30, 61), (2, 2, 1, 1)])
def test_blocks_do_not_show(spark, arity, levels, groups, n):
    r = random.Random(n)
    rows = [(r.choice([i, i, None, 5]), r.choice(["a", None]), r.choice([None, *map(str, range(groups))]) if groups > 1 else "x",
             r.choice([None, 3]), f"text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    changed = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    found = merkle.manifest(df, COLUMNS, arity=arity, levels=levels, changes={"n_chars": F.col("n_chars") + 1}, when=changed)
    got = found.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", F.col("folded_root") == F.col("root"))
    assert Counter(tuple(x) for x in got.collect()) == Counter(brute.merkle(rows, arity))


def test_versions_copy_a_path_and_share_the_rest():
    leaves = [merkle.combined([str(i)]) for i in range(11)]
    tree = merkle.Tree(list(leaves), 2, None)
    before = [list(x) for x in tree.levels]
    for at in range(11):
        path = tree.version(at, "new")
        other = merkle.Tree([*leaves[:at], "new", *leaves[at + 1:]], 2, None)
        assert path == [nodes[at >> k] for k, nodes in enumerate(other.levels)]
        assert len(path) == len(tree.levels)
        assert sum(a != b for x, y in zip(tree.levels, other.levels) for a, b in zip(x, y)) == len(path)
    assert tree.levels == before


def test_manifest_without_changes_verifies(spark, edge_dir):
    found = merkle.manifest(spark.read.parquet(f"{edge_dir}/documents.parquet"), ["text"], group="source", levels=2).collect()
    assert found and all(r["folded_root"] == r["root"] and r["changed"] is None for r in found)


@pytest.mark.parametrize("reach, dims, mixed", [(3e5, 64, False), (5e5, 16, False), (5e5, 16, True), (4e5, 40, True), (3.0, 8, False)])
def test_scores_beyond_doubles_are_exact(spark, reach, dims, mixed):
    """Components up to 5e8, scores to 9e17 and (mixed: sums that cancel) beyond 64 bits on the way."""
    r = random.Random(dims)
    rows = [(i, [r.uniform(-reach, reach) * (1000 if mixed and i % 50 == 3 and d < 2 else 1) for d in range(dims)]) for i in range(300)]
    if mixed:  # large parts that cancel against the queries
        rows = [(i, [v[0], -v[0], *v[2:]] if i % 50 == 3 else [abs(v[0])] * 2 + v[2:]) for i, v in rows]
    rows += [(i + 1000, rows[i][1]) for i in range(20)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute.top_k(rows)


def test_scores_beyond_64_bits_are_an_error(spark):
    for rows in ([(0, [4e6] * 8), (1, [4e6] * 8), (2, [1.0] * 8)], [(0, [1e300]), (1, [1.0])]):
        rows = [(i, [x * 1000 for x in v]) for i, v in rows]
        with pytest.raises(Exception, match="beyond 64 bits"):
            topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).collect()
