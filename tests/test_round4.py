"""Round 4: fits whose cost follows the rows, shared turns of the k sweep."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from fairplay.operators import cluster as CL
from fairplay.operators import ingest as IN
from fairplay.operators import runs as RU
from fairplay.sources import html_tables as HT


def groups(spark, tasks=16):
    r = np.random.default_rng(1)
    pts = np.vstack([r.normal(m, 1.5, (40, 3)) for m in (0, 4, 9)])
    return spark.createDataFrame([(i, Vectors.dense(p)) for i, p in enumerate(pts)], ["id", "features"]).repartition(tasks)


def test_fits_read_a_materialised_frame_by_size(spark):
    df = groups(spark)
    rows = CL.fit_frame(df.join(groups(spark).select("id"), "id"))
    assert rows.rdd.getNumPartitions() == 1
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 120


def test_shared_turns_equal_single_fits(spark):
    rows = CL.fit_frame(groups(spark))
    starts, want = [], []
    for k, seed in ((2, 7), (4, 7), (4, 8)):
        starts.append(np.array(KMeans(k=k, seed=seed, maxIter=0).fit(rows).clusterCenters()))
        want.append(KMeans(k=k, seed=seed, maxIter=300).fit(rows))
    for (centres, cost), model in zip(CL.lloyd(rows, starts, 300), want, strict=True):
        assert np.allclose(centres, model.clusterCenters()) and np.isclose(cost, model.summary.trainingCost)


def test_vector_metrics_equal_the_long_form(spark):
    df = groups(spark)
    pred = KMeans(k=4, seed=7).fit(df).transform(df)
    wide = pred.select("id", *[vector_to_array("features")[i].alias(f"f{i}") for i in range(3)])
    long = CL.cluster_metrics(CL.to_long(wide, "id", ["f0", "f1", "f2"]), pred.selectExpr("id", "prediction AS label")).first()
    assert np.allclose(CL.vector_metrics(pred), [long.calinski_harabasz, long.davies_bouldin])
    assert CL.vector_metrics(pred.where("prediction = 0")) == (None, None)


def test_chosen_tables_alone_equal_those_of_the_cells(spark):
    rows = [(1, 0, "a", "Rk"), (1, 1, "b", "Perf_Fls"), (1, 1, "b", "Player"), (1, 2, "c", "Fls"), (2, 0, None, "x"), (2, 1, "my_misc", "y"),
            (3, 0, "stats_misc", "x"), (3, 0, "other", "x"), (4, 0, None, None), (4, 1, None, "CrdY"), (4, 1, None, "Min"), (4, 2, None, "Min")]
    cells = spark.createDataFrame(rows, "page_id long, table_no int, table_id string, header string")
    for policy in ("keyword", "player_foul", "score"):
        whole = IN.pick_table(cells, policy).select("page_id", "table_no", "table_id").distinct().collect()
        tables = IN.pick_table(cells, policy, tables_only=True)
        assert sorted(map(str, whole)) == sorted(map(str, tables.collect()))
    assert "Window" not in tables._jdf.queryExecution().optimizedPlan().toString().partition("Aggregate")[2]  # cells meet the aggregate first


def test_parser_emits_small_batches():
    import pyarrow as pa

    html = "<table id=t><tr><th>A</th><th>B</th></tr>" + "<tr><td>1</td><td>2</td></tr>" * 600 + "</table>"
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(100)), "html": [html] * 99 + [None], "league": [f"l{i}" for i in range(100)]})
    got = list(HT._parser(["league"])(iter([pages])))
    assert sum(b.num_rows for b in got) == 99 * 1200 and max(b.num_rows for b in got) <= HT._ROWS + 1200
    assert all(r["league"] == f"l{r['page_id']}" for b in got for r in b.to_pylist())


def test_records_of_training_read_the_importances_once(spark):
    fits = spark.sql("SELECT 'r1' AS run_id, 'e' AS experiment, 'm' AS model, 't' AS target, timestamp'2024-01-01 00:00:00' AS start_time, "
                     "timestamp'2024-01-01 01:00:00' AS end_time, 2L AS n_features, 5L AS n_train_samples, CAST(NULL AS LONG) AS n_val_samples")
    scores = spark.createDataFrame([("r1", "val", "rmse", "0.5")], "run_id string, part string, key string, value string")
    importances = spark.createDataFrame([("r1", f"f{i}", float(i)) for i in range(12)], "run_id string, feature string, importance double")
    made = RU.training_records(fits, scores, importances)
    for name in ("run_metrics", "run_params"):  # neither ranks the importances again
        assert "Window" not in made[name]._jdf.queryExecution().optimizedPlan().toString()
    top = {r.key: r.value for r in made["run_params"].collect()}
    assert [top[f"top_feature_{i}"] for i in range(1, 11)] == [f"f{i}" for i in range(11, 1, -1)]
    assert {r.key: r.value for r in made["run_metrics"].collect()}["feature_importance_1"] == 11.0
