"""K12, K13, F26 and C15 of this round."""

import datetime
import json
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fairplay.operators import cluster as CL
from fairplay.operators import features as FE
from fairplay.operators import screening as SC


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(2)
    x = [[r.gauss(5 * (i % 3), 1), r.gauss(0, 2), r.gauss(i % 3, 0.5)] for i in range(90)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, v array<double>")
    labels = spark.createDataFrame([(i, i % 3 if i < 80 else -1) for i in range(90)], "id long, label int")
    return np.array(x), df.select("id", array_to_vector("v").alias("features")), labels


def test_nearest_centre_of_new_rows(points, spark):
    x, vec, labels = points
    got = {r["id"]: r["prediction"] for r in CL.assign_to_clusters(vec, vec, labels).collect()}
    centres = [x[:80][np.arange(80) % 3 == k].mean(axis=0) for k in range(3)]
    assert got == {i: int(np.argmin([((v - c) ** 2).sum() for c in centres])) for i, v in enumerate(x)}
    noise = labels.withColumn("label", F.lit(-1))
    assert {r["prediction"] for r in CL.assign_to_clusters(vec, vec, noise).collect()} == {-1}


def test_scatter_has_centres_and_ratio(points):
    x, vec, labels = points
    rows = CL.pca_scatter(vec, labels).collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    vt = np.array([v if v[np.argmax(np.abs(v))] >= 0 else -v for v in vt])
    image = z @ vt[:2].T
    for r in rows:
        want = image[r["id"]] if r["kind"] == "point" else ((x[:80][np.arange(80) % 3 == r["label"]].mean(axis=0) - x.mean(axis=0)) / x.std(axis=0)) @ vt[:2].T
        assert [r["pc1"], r["pc2"]] == pytest.approx(want, abs=1e-9)
        assert [r["ratio1"], r["ratio2"]] == pytest.approx((s ** 2 / (s ** 2).sum())[:2])
    assert sum(r["kind"] == "centre" for r in rows) == 3 and len(rows) == 93


def test_features_are_chosen_on_train_rows(spark):
    r = random.Random(3)
    rows = [(i, r.random(), r.random(), "train" if i < 60 else "test") for i in range(120)]
    df = spark.createDataFrame([(i, a, b, a + 0.1 * b if s == "train" else 50 * b, s) for i, a, b, s in rows], "player_id long, a double, b double, fouls double, split string")
    assert FE.select_features(df, "fouls", 1, ("player_id", "split"))[1] == ["b"]
    assert FE.select_features(df, "fouls", 1, ("player_id", "split"), F.col("split") == "train")[1] == ["a"]


def sanitized(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    return [r["s"] for r in df.select("i", SC.json_sanitize("d").alias("s")).orderBy("i").collect()]


def test_deep_documents_are_sanitized(spark):
    n = 30_000
    deep = '{"a":[' * n + '"<b>x</b>\\u0000 y"' + "]}" * n
    got, broken, shallow = sanitized(spark, [deep, deep[:-1], '{"a": ["<b>x</b>\\u0000 y"]}'])
    leaf = json.loads(shallow)["a"][0]
    assert broken is None
    assert got == '{"a": [' * n + json.dumps(leaf, ensure_ascii=False) + "]}" * n


def test_the_token_walk_reads_what_the_parser_reads():
    r = random.Random(1)

    def value(depth):
        kind = r.randint(0, 7 if depth else 5)
        return [None, True, r.randint(-9, 9), r.random() * 1e5, "<i>te\\xt é</i>", "a\"b\\u0041", [value(depth - 1) for _ in range(r.randint(0, 3))] if depth else "",
                {f"k{j}": value(depth - 1) for j in range(r.randint(0, 3))} if depth else 0][kind]

    for _ in range(300):
        v = value(4)
        text = json.dumps(v, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 2]))
        assert SC._deep_value(text) == v
        assert SC._deep_text(v) == json.dumps(SC._sanitize_value(v), ensure_ascii=False)
        cut = text[:r.randrange(len(text))] + r.choice(["", ",", "]", "}", ":", "x"])
        try:
            want = json.loads(cut)
        except ValueError:
            with pytest.raises(ValueError):
                SC._deep_value(cut)
        else:
            assert SC._deep_value(cut) == want


def test_exports_keep_quotes_breaks_and_microseconds(spark, tmp_path):
    from fairplay.sources import sinks as SK

    rows = [(1, 'a "b", c', datetime.datetime(2024, 1, 1, 0, 0, 0, 123456)), (2, "x\ny", None), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, words string, at timestamp")
    SK.export_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, SK.read_csv(spark, str(tmp_path / "csv"), df.schema).collect())) == rows
    SK.export_json(df, str(tmp_path / "json"))
    assert sorted(map(tuple, SK.read_json(spark, str(tmp_path / "json"), df.schema).collect())) == rows


def test_training_records(spark):
    from fairplay.operators import runs as RU

    at = datetime.datetime(2024, 1, 2)
    fits = spark.createDataFrame([("r2", "e", "m", "fouls", at, at, 12, 70, 30), ("r1", "e", "m", "fouls", at, at, 12, 70, None)],
                                 "run_id string, experiment string, model string, target string, start_time timestamp, end_time timestamp, "
                                 "n_features int, n_train_samples long, n_val_samples long")
    scores = spark.createDataFrame([("r1", "val", "rmse", "1.5"), ("r1", "train", "note", "good"), ("r1", "test", "rmse", "2")],
                                   "run_id string, part string, key string, value string")
    imp = spark.createDataFrame([("r1", f"f{i:02d}", float(i // 2)) for i in range(12)], "run_id string, feature string, importance double")
    stored = spark.createDataFrame([("m", "fouls", 4)], "model string, target string, version int")
    out = RU.training_records(fits, scores, imp, stored)
    metrics = {r.key: r.value for r in out["run_metrics"].collect()}
    assert metrics["val_rmse"] == 1.5 and len(metrics) == 11 and metrics["feature_importance_10"] == 1.0
    params = {(r.run_id, r.key): r.value for r in out["run_params"].collect()}
    assert [params["r1", f"top_feature_{i}"] for i in (1, 2, 10)] == ["f10", "f11", "f03"]
    assert params["r2", "n_val_samples"] == "30" and ("r1", "n_val_samples") not in params
    assert {(r.run_id, r.version) for r in out["model_versions"].collect()} == {("r1", 5), ("r2", 6)}
    assert {r.key: r.value for r in out["run_tags"].where("run_id = 'r1'").collect()}["training_date"] == "2024-01-02"


def test_sessions_close_after_the_gap(spark):
    from fairplay.streaming import live as LV

    at = [datetime.datetime(2024, 1, 1, 0, m, s) for m, s in ((0, 0), (30, 0))] + [datetime.datetime(2024, 1, 1, 1, 0, 1)]
    log = spark.createDataFrame([(t, "a") for t in at], "ts timestamp, client string")
    assert sorted(r.requests for r in LV.session_counts(log).collect()) == [1, 2]


def test_newest_matches_reach_the_scans(spark):
    from fairplay.plans.catalog import load_all
    from tests.conftest import SF_SMALL

    p = load_all()["q21_trailing_period"].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in p
    for name in ("q13_recent_matches", "q15_list_matches"):
        p = load_all()[name].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "In(l_orderkey" in p and "In(o_orderkey" in p
