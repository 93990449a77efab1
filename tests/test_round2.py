"""Safe upserts, unclipped outputs, whole clusters, forest samples, deep JSON."""

import json
import math

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fairplay.operators import anomaly as AN
from fairplay.operators import cluster as CL
from fairplay.operators import screening as SC
from fairplay.operators.neighbors import dbscan
from fairplay.plans.catalog import finish
from fairplay.sources import sinks as SK


def test_outputs_keep_large_and_special_values(spark):
    values = [2e13, 1.5e300, float("inf"), -float("inf"), float("nan"), None, 2.675, -0.1234567]
    got = [r["x"] for r in finish(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")).orderBy("i").collect()]
    assert got[:4] == values[:4]
    assert math.isnan(got[4]) and got[5] is None
    assert got[6:] == [2.675, -0.123457]


KEYS = ["league", "season", "player_name", "team"]


def test_upsert_keeps_stored_columns_and_untouched_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("A", "2020", "p", "x", "GK", 1), ("A", "2020", "q", "x", "DF", 2), ("B", "2020", "r", "y", "FW", 3)],
                                  "league string, season string, player_name string, team string, position string, fouls int")
    assert SK.upsert_to_path(spark, path, first) == 3
    batch = spark.createDataFrame([("A", "2020", "p", "x", 9, 1), ("A", "2020", "p", "x", 8, 2), ("A", "2021", "s", "x", 5, 1)],
                                  "league string, season string, player_name string, team string, fouls int, load int")
    best = SK.one_per_key(batch, KEYS, ["load"]).drop("load")
    assert SK.upsert_to_path(spark, path, best.withColumn("note", F.lit("n"))) == 3
    types = {c: first.schema[c].dataType for c in ("league", "season")}
    got = sorted((r["league"], r["season"], r["player_name"], r["position"], r["fouls"]) for r in SK.stored_table(spark, path, types).collect())
    assert got == [("A", "2020", "p", "GK", 8), ("A", "2020", "q", "DF", 2), ("A", "2021", "s", None, 5), ("B", "2020", "r", "FW", 3)]


def test_upsert_reads_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40).select(F.concat(F.lit("L"), F.col("id") % 8).alias("league"), F.lit("2020").alias("season"),
                                  F.col("id").cast("string").alias("player_name"), F.lit("x").alias("team"), F.col("id").alias("fouls"))
    SK.upsert_to_path(spark, path, rows)
    for f in (tmp_path / "t" / "league=L5").rglob("*.parquet"):
        f.write_bytes(b"not a table")  # a scan of this partition would fail
    SK.upsert_to_path(spark, path, rows.where("league = 'L3'").withColumn("fouls", F.lit(1).cast("long")))


def test_upsert_raises_where_the_target_cannot_be_read(spark, tmp_path):
    path = tmp_path / "t"
    path.mkdir()
    (path / "part-0.parquet").write_bytes(b"broken")
    rows = spark.createDataFrame([("A", "2020", "p", "x", 1)], "league string, season string, player_name string, team string, fouls int")
    with pytest.raises(Exception) as e:
        SK.upsert_to_path(spark, str(path), rows)
    assert not (isinstance(e.value, AnalysisException) and e.value.getCondition() == "PATH_NOT_FOUND")
    assert (path / "part-0.parquet").read_bytes() == b"broken"


def test_dbscan_chain_is_one_cluster(spark):
    pts = spark.range(260).select("id", F.array(F.col("id") * 0.4, F.lit(0.0)).alias("x"), F.array(F.col("id") * 0.4, F.lit(0.0)).alias("g"))
    labels = dbscan(pts, eps=0.5, min_samples=3).groupBy("label").count().collect()
    assert [(r["label"], r["count"]) for r in labels] in ([(0, 260)], [(1, 260)])


def test_forest_trees_have_their_sample_and_ignore_partitions(spark):
    pts = spark.range(900).select("id", F.array(F.sin(F.col("id")), F.cos(F.col("id") * 2)).alias("x"))
    trees, psi = AN.fit_isolation_forest(pts, n_trees=20, sample_size=256)
    again, _ = AN.fit_isolation_forest(pts.repartition(13), n_trees=20, sample_size=256)
    assert psi == 256 and len(trees) == 20
    for t, u in zip(trees, again):
        leaves = t[t[:, 0] < 0]
        assert leaves[:, 4].sum() == 256
        assert (t == u).all()


def test_cluster_medians_are_exact(spark):
    long = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate([1, 2, 3, 4, 7, 7, 7, 1])], "id long, feature string, value double")
    labels = spark.createDataFrame([(i, int(i >= 4)) for i in range(8)], "id long, label int")
    assert {r["label"]: r["median"] for r in CL.cluster_medians(long, labels).collect()} == {0: 2.5, 1: 7.0}


def test_deep_json_is_too_deep_and_does_not_stop_the_job(spark):
    deep = "[" * 30000 + '"]["' + "]" * 30000
    df = spark.createDataFrame([(1, deep), (2, json.dumps({"a": [1]})), (3, "{")], "id int, doc string")
    got = {r["id"]: r for r in df.select("id", SC.json_limits("doc").alias("l"), SC.json_sanitize("doc").alias("s")).collect()}
    assert got[1]["l"]["valid_json"] and "too_deep" in got[1]["l"]["violations"] and got[1]["s"] == deep
    assert got[2]["s"] == '{"a": [1]}' and got[3]["l"]["violations"] == ["invalid_json"]


def test_trailing_blocks_see_what_whole_groups_see(spark):
    from pyspark.sql import Window

    from fairplay.plans.windows import trailing_blocks

    rows = [("hot" if i % 3 else None, i * 7 % 101, float(i % 13)) for i in range(101)] + [("one", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, o int, v double")
    whole = Window.partitionBy("g").orderBy("o").rowsBetween(-4, 0)
    want = sorted((str(r["g"]), r["o"], r["m"], r["n"]) for r in df.select(
        "g", "o", F.avg("v").over(whole).alias("m"), F.count("v").over(whole).alias("n")).collect())
    x, w = trailing_blocks(df, ["g"], ["o"], 4, width=8)
    w = w.rowsBetween(-4, 0)
    got = sorted((str(r["g"]), r["o"], r["m"], r["n"]) for r in x.withColumn("m", F.avg("v").over(w)).withColumn(
        "n", F.count("v").over(w)).where("_halo = 0").collect())
    assert got == want
