"""Cases of the second review: ids in several rows, null and large ids."""

import random
from collections import Counter

from pyspark.sql import functions as F

from fairplay.llm import html_text, mixing, pieces, ppm, simhash, suffix_dedup, topk
from tests.llm import brute


def candidate(r, i):
    """Every fifth is a query, weak in all groups of dimensions; half of the others are the
    best neighbours, even over the groups; the rest lead the list of one group each."""
    if i % 5 == 0:
        return [0.1 + 0.01 * r.random() for _ in range(8)]
    if i % 2:
        return [0.44 + 0.02 * r.random() for _ in range(8)]
    return [1 + 0.1 * r.random() if i // 2 % 4 == d // 2 else 0.01 * r.random() for d in range(8)]


def test_top_k_with_ids_in_several_rows(spark):
    r = random.Random(5)
    for times in (2, 3, 12):
        rows = [(20 * i, candidate(r, i)) for i in range(150)]
        rows = [row for row in rows for _ in range(times if row[0] % 100 else 1)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        got = sorted(tuple(x) for x in topk.search(df, F.col("id") % 100 == 0).collect())
        assert got == brute.top_k(rows), times


LARGE = 2 ** 53 + 1


def test_top_k_leaves_out_rows_without_an_id(spark):
    r = random.Random(6)
    rows = [(i, [r.random() for _ in range(4)]) for i in range(30)] + [(LARGE, [2.0] * 4)]
    df = spark.createDataFrame([*rows, (None, [3.0] * 4), (None, [1.0] * 4)], "vec_id long, embedding array<double>").coalesce(1)
    got = sorted(tuple(x) for x in topk.search(df, (F.col("id") % 100 == 0) | F.col("id").isNull()).collect())
    assert got == brute.top_k(rows)
    assert got[0][1:3] == (1, LARGE)


def test_large_ids_beside_a_null_id_stay_exact(spark):
    import public_tokenizers

    df = spark.createDataFrame([(LARGE, "some words to read"), (None, "no id at all"), (-LARGE, "other words, not these")],
                               "doc_id long, text string").coalesce(1)
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    model = public_tokenizers.path("piece_bpe_32k.model")
    for out in (html_text.extract(pages), ppm.score(df), pieces.round_trip(df, model), pieces.encode(df, model),
                suffix_dedup.removed(df), simhash.near_duplicates(df), simhash.keep_one(df)):
        assert out.dtypes[0][1] == "bigint"
        assert sorted((x[0] for x in out.collect()), key=lambda x: x or 0) == [-LARGE, None, LARGE], out.columns


def test_mix_decides_by_row_for_null_and_repeated_keys(spark):
    r = random.Random(8)
    rows = [(key, " ".join([f"{source}{key}{i}"] * r.randint(20, 60)), source)
            for source, n in (("a", 60), ("b", 90)) for key in (None, 7, 8) for i in range(n if key is None else n // 3)]
    rows += [rows[0]] * 3 + [rows[-1]] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mix(df, seed=7)
    got = [tuple(x) for x in out.collect()]
    assert out.columns == df.columns
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    for _, t, s in got:
        taken[s] += len(t.split())
    want = brute.targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes), (taken, want)
    once, often = Counter(rows), Counter(got)
    assert all(int(want[x[2]] // sizes[x[2]]) * n <= often[x] <= (int(want[x[2]] // sizes[x[2]]) + 1) * n for x, n in once.items())
    assert Counter(got) == Counter(tuple(x) for x in mixing.mix(df.repartition(3), seed=7).collect())
