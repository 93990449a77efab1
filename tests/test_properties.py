"""Layer 3: properties of the model-based operators (planted answers, brute force, round trips)."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fairplay.operators import anomaly as AN
from fairplay.operators import cluster as CL
from fairplay.operators import neighbors as NB
from fairplay.operators import predict as PR
from tests.conftest import SF_CHECK


def blobs(spark, n_per=60, seed=1, outlier=True):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [10, 10, 0], [0, 10, 10]], dtype=float)
    rows, i = [], 0
    for c in centres:
        for p in c + rng.normal(0, 0.5, size=(n_per, 3)):
            rows.append((i, [float(v) for v in p]))
            i += 1
    if outlier:
        rows.append((i, [40.0, -40.0, 40.0]))
    df = spark.createDataFrame(rows, "id long, x array<double>")
    return df.withColumn("g", F.slice("x", 1, 2)).withColumn("features", array_to_vector("x"))


def test_kmeans_finds_planted_blobs(spark):
    df = blobs(spark, outlier=False)
    model, cost = CL.kmeans_best(df, k=3, restarts=3, max_iter=50)
    pred = model.transform(df).select("id", "prediction").collect()
    assert len(pred) == 180
    groups = {}
    for r in pred:
        groups.setdefault(r.id // 60, set()).add(r.prediction)
    assert all(len(v) == 1 for v in groups.values())
    assert len({next(iter(v)) for v in groups.values()}) == 3


def test_cluster_metrics_match_numpy(spark):
    df = blobs(spark, n_per=20, outlier=False)
    model, _ = CL.kmeans_best(df, k=3, restarts=1, max_iter=20)
    pred = model.transform(df)
    long = CL.to_long(pred.select("id", *[F.col("x")[i].alias(f"f{i}") for i in range(3)]), "id",
                      ["f0", "f1", "f2"])
    labels = pred.select("id", F.col("prediction").alias("label"))
    m = CL.cluster_metrics(long, labels).first()
    x = np.array([r.x for r in pred.orderBy("id").collect()])
    lab = np.array([r.prediction for r in pred.orderBy("id").collect()])
    ks = sorted(set(lab))
    mu = np.array([x[lab == k].mean(axis=0) for k in ks])
    g = x.mean(axis=0)
    bss = sum((lab == k).sum() * ((mu[i] - g) ** 2).sum() for i, k in enumerate(ks))
    wss = sum(((x[lab == k] - mu[i]) ** 2).sum() for i, k in enumerate(ks))
    ch = (bss / 2) / (wss / (len(x) - 3))
    assert m.calinski_harabasz == pytest.approx(ch, rel=1e-9)
    # squared-Euclidean silhouette by brute force
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == k].mean() for k in ks if k != lab[i])
        s.append((b - a) / max(a, b))
    assert m.silhouette_sq_euclidean == pytest.approx(np.mean(s), rel=1e-9)


def brute_dbscan(x, eps, min_samples):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    nb = d <= eps
    core = nb.sum(axis=1) >= min_samples
    comp = -np.ones(n, dtype=int)
    for i in range(n):
        if core[i] and comp[i] < 0:
            stack, comp[i] = [i], i
            while stack:
                j = stack.pop()
                for k in np.flatnonzero(nb[j] & core):
                    if comp[k] < 0:
                        comp[k] = i
                        stack.append(k)
    label = comp.copy()
    for i in range(n):
        if not core[i]:
            cand = [(d[i, k], k) for k in np.flatnonzero(nb[i] & core)]
            label[i] = comp[min(cand)[1]] if cand else -1
    return core, label


def _same_partition(a, b):
    m1, m2 = {}, {}
    for x, y in zip(a, b):
        if (x == -1) != (y == -1):
            return False
        if x == -1:
            continue
        if m1.setdefault(x, y) != y or m2.setdefault(y, x) != x:
            return False
    return True


def test_dbscan_equals_brute_force_on_embeddings(spark):
    from fairplay.plans.jobs_models import _embedding_points

    pts = _embedding_points(spark, SF_CHECK)
    rows = pts.orderBy("id").collect()
    x = np.array([r.x for r in rows])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    eps = float(np.quantile(d[np.triu_indices(len(x), 1)], 0.02))
    got = {r.id: r for r in NB.dbscan(pts, eps=eps, min_samples=5).collect()}
    core, label = brute_dbscan(x, eps, 5)
    ids = [r.id for r in rows]
    assert [got[i].is_core for i in ids] == list(core)
    assert _same_partition([got[i].label for i in ids], list(label))


def test_knn_exact(spark):
    df = blobs(spark, n_per=30)
    nn = NB.knn(df, 5).collect()
    x = {r.id: np.array(r.x) for r in df.collect()}
    ids = sorted(x)
    for i in ids[:20]:
        want = sorted((float(np.linalg.norm(x[i] - x[j])), j) for j in ids if j != i)[:5]
        got = sorted((r.dist, r.nid) for r in nn if r.id == i)
        assert [j for _, j in got] == [j for _, j in want]


def test_lof_ranks_planted_outlier_first(spark):
    df = blobs(spark, n_per=40)
    lof = NB.local_outlier_factor(df, k=10).orderBy(F.col("lof").desc()).first()
    assert lof.id == 120


def test_isolation_forest_flags_planted_outlier(spark):
    df = blobs(spark, n_per=60)
    out = AN.isolation_forest(df, contamination=0.05, n_trees=50)
    worst = out.orderBy("score").first()
    assert worst.id == 180 and worst.is_anomaly


def test_kernel_novelty_flags_planted_outlier(spark):
    df = blobs(spark, n_per=60)
    out = AN.kernel_novelty(df, nu=0.05)
    assert out.orderBy("score").first().id == 180


def test_ward_merge_joins_nearest():
    c = np.array([[0.0], [0.1], [10.0], [10.1]])
    assert len(set(CL.ward_merge(c, np.ones(4), 2)[:2])) == 1
    assert CL.ward_merge(c, np.ones(4), 2)[0] != CL.ward_merge(c, np.ones(4), 2)[2]


def test_splits_disjoint_complete_repeatable(spark):
    from fairplay.sources.tables import player_match

    pm = player_match(spark, SF_CHECK).select("player_id", "match_id", "match_date")
    a = PR.random_split(pm, ["player_id", "match_id"]).select("match_id", "split")
    b = PR.random_split(pm.repartition(13), ["player_id", "match_id"]).select("match_id", "split")
    assert a.count() == pm.count() and a.select("match_id").distinct().count() == pm.count()
    assert a.exceptAll(b).count() == 0
    t = PR.time_split(pm, "match_date", ["match_id"])
    n = pm.count()
    counts = {r.split: r["count"] for r in t.groupBy("split").count().collect()}
    assert counts["test"] == n - int(n * 0.8) and counts["train"] == int(n * (1 - 0.2 - 0.1))
    mx = t.groupBy("split").agg(F.max("match_date").alias("mx"), F.min("match_date").alias("mn"))
    r = {x.split: x for x in mx.collect()}
    assert r["train"].mx <= r["val"].mn and r["val"].mx <= r["test"].mn


def test_ridge_and_lasso_match_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([1.5, -2.0, 0.5]) + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)],
                               "x array<double>, label double").withColumn("features", array_to_vector("x"))
    m = PR.fit("linear", "fouls", df)  # ridge, alpha 1.0
    xc = np.c_[x, np.ones(200)]
    reg = np.eye(4) * 1.0
    reg[3, 3] = 0
    xm, ym = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + np.eye(3) * 1.0, (x - xm).T @ (y - ym))
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-3)
    lasso = PR.fit("linear", "red_cards", df)
    assert lasso.coefficients.toArray()[0] == pytest.approx(1.5 - 0.1 / np.var(x[:, 0]), abs=0.05)


def test_model_save_load_round_trip(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.regression import RandomForestRegressor

    from fairplay.sources.sinks import save_model

    df = blobs(spark, n_per=20, outlier=False).withColumn("label", F.col("x")[0])
    pm = Pipeline(stages=[RandomForestRegressor(numTrees=5, seed=1)]).fit(df)
    path = str(tmp_path / "m")
    save_model(pm, path)
    again = PipelineModel.load(path)
    a = [r.prediction for r in pm.transform(df).orderBy("id").collect()]
    b = [r.prediction for r in again.transform(df).orderBy("id").collect()]
    assert a == b


def test_sliding_admission_and_token_bucket_match_brute_force(spark):
    from fairplay.sources.tables import requests_log
    from fairplay.streaming.admission import sliding_admission, token_bucket

    req = requests_log(spark, SF_CHECK)
    rows = sorted(((r.client, r.ts.timestamp(), r.event_id) for r in req.collect()))
    lim, win = 3, 3600.0
    want_sa, state = {}, {}
    for key, t, eid in rows:
        times = [x for x in state.get(key, []) if x > t - win]
        ok = len(times) < lim
        if ok:
            times.append(t)
        state[key] = times
        want_sa[eid] = ok
    got = {r.event_id: r.admitted for r in sliding_admission(req, lim, win).collect()}
    assert got == want_sa
    cap, rate = 3.0, 1 / 1200
    want_tb, st = {}, {}
    for key, t, eid in rows:
        tok, last = st.get(key, (cap, t))
        tok = min(cap, tok + (t - last) * rate)
        ok = tok >= 1
        if ok:
            tok -= 1
        st[key] = (tok, t)
        want_tb[eid] = ok
    got = {r.event_id: r.admitted for r in token_bucket(req, cap, rate).collect()}
    assert got == want_tb


def test_sliding_log_halo_blocks_are_exact(spark):
    from fairplay.sources.tables import requests_log
    from fairplay.streaming.admission import sliding_log_counts

    req = requests_log(spark, SF_CHECK)
    small = {r.event_id: r.in_window for r in sliding_log_counts(req, 3600, block_windows=1).collect()}
    large = {r.event_id: r.in_window for r in sliding_log_counts(req, 3600, block_windows=1000).collect()}
    assert small == large


def test_html_tables_in_comments_and_rejects():
    from fairplay.sources.html_tables import parse_tables

    html = ("<table id='a'><tr><th>X</th><th>Y</th></tr><tr><td>1</td><td>2</td></tr></table>"
            "<!-- <table id='b'><thead><tr><th colspan='2'>Top</th></tr><tr><th>P</th><th>Q</th></tr></thead>"
            "<tr><td>3</td><td>4</td></tr></table> -->"
            "<table id='c'><tr><td>1</td></tr></table>")
    rows = parse_tables(html, 7)
    ok = [r for r in rows if r[-1] == "ok"]
    assert {(r[2], r[5], r[6]) for r in ok} == {("a", "X", "1"), ("a", "Y", "2"), ("b", "Top_P", "3"),
                                               ("b", "Top_Q", "4")}
    assert [r[-1] for r in rows if r[-1] != "ok"] == ["no_header"]


def test_training_job_small(spark):
    """M1-M5, M8-M12 on the smallest tables: every (model, target) fitted, sane metrics."""
    from fairplay.plans import training as TR

    frame = TR.training_frame(spark, "/root/testdata/sf0.001").cache()
    models = TR.train_models(frame, kinds=["random_forest", "linear"])
    ev = {(r.model, r.target): r for r in TR.evaluate(frame, models).collect()}
    assert set(ev) == {(m, t) for m in ["random_forest", "linear", "ensemble"] for t in PR.TARGETS}
    for r in ev.values():
        assert r.rmse >= 0 and r.samples > 0 and r.mean_predicted >= 0
    imp = TR.importances(models, spark).collect()
    assert imp and all(r.importance >= 0 for r in imp)
