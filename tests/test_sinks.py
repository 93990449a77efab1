"""Sinks and the experiment-store writer."""

import datetime

from pyspark.sql import functions as F

from fairplay.operators import runs as RU
from fairplay.sources import sinks as SK


def test_csv_and_json_exports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.5)], "id int, feature string, importance double")
    SK.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).schema(df.schema).csv(str(tmp_path / "csv"))
    assert sorted(back.collect()) == sorted(df.collect())
    nested = df.select("id", F.struct("feature", "importance").alias("top"),
                       F.create_map(F.col("feature"), F.col("importance")).alias("m"))
    SK.export_json(nested, str(tmp_path / "json"))
    again = spark.read.schema(nested.schema).json(str(tmp_path / "json"))
    assert sorted(r.top.feature for r in again.collect()) == ["a", "b"]


def test_log_run_appends_numeric_metrics_only(spark, tmp_path):
    root = str(tmp_path / "store")
    t0 = datetime.datetime(2024, 1, 1)
    for rid in ("r1", "r2"):
        RU.log_run(spark, root, {"run_id": rid, "experiment": "e", "name": rid, "status": "FINISHED",
                                 "start_time": t0, "end_time": t0},
                   {"val_rmse": 1.5, "train_r2": 0.8, "model_type": "xgboost", "flag": True},
                   params={"depth": 6}, tags={"target": "fouls"})
    runs = spark.read.parquet(f"{root}/runs")
    metrics = spark.read.parquet(f"{root}/run_metrics")
    assert runs.count() == 2
    assert sorted(r.key for r in metrics.where("run_id = 'r1'").collect()) == ["train_r2", "val_rmse"]
    assert spark.read.parquet(f"{root}/run_params").count() == 2
    details = RU.run_details(runs).collect()
    assert all(r.duration_seconds == 0 for r in details)


def load(spark, path, rows, **how):
    cols = "league string, season string, player_name string, team string, fouls int"
    return SK.upsert_to_path(spark, path, spark.createDataFrame(rows, cols), **how)


def test_null_keys_are_updated_not_added(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("A", "2020", "x", None, 1), ("A", None, "y", "t", 2), (None, None, "z", "t", 3), ("B", "2021", "x", "t", 4)]
    for k in range(3):
        load(spark, path, [(*r[:4], r[4] + 10 * k) for r in rows])
    back = spark.read.schema("league string, season string, player_name string, team string, fouls int").parquet(path)
    assert sorted(r["fouls"] for r in back.collect()) == [21, 22, 23, 24]


def test_a_failed_batch_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, [("A", "2020", "x", "t", 1), ("B", "2020", "y", "t", 2)])
    bad = spark.createDataFrame([("A", "2020", "x", "t", 9), ("B", "2020", "y", "t", 0)], "league string, season string, player_name string, team string, f int")
    broken = bad.withColumn("fouls", F.when(F.col("f") == 0, F.raise_error(F.lit("broken row")).cast("int")).otherwise(F.col("f"))).drop("f")
    try:
        SK.upsert_to_path(spark, path, broken)
        raise AssertionError("the batch should fail")
    except Exception as e:
        assert "broken row" in str(e)
    assert sorted(r["fouls"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_only_touched_partitions_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, [(x, str(y), "p", "t", 1) for x in "ABC" for y in range(2000, 2010)])
    rows = spark.createDataFrame([(x, str(y)) for x in "AB" for y in range(2000, 2005)] + [(None, "2001"), ("A", None)], "league string, season string").collect()
    scope = spark.read.parquet(path).where(SK._touches(rows, ["league", "season"]))
    assert scope.count() == 10
    plan = scope._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "league" in plan.split("PartitionFilters: [")[1].split("]")[0]
