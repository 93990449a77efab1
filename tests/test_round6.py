"""Features and fits that read their rows once."""

import numpy as np
from pyspark.sql import functions as F

from fairplay.operators import features as FE
from fairplay.operators import predict as PR
from fairplay.operators import tuning as TU


def _seasons(spark, n=60):
    rows = [(i % 12, f"p{i % 12}", f"t{i % 3}", f"l{i % 2}", f"{2000 + i // 12}-{2001 + i // 12}", 2000 + i // 12, ["GK", "DF", "MF,FW"][i % 3],
             5 + i % 7, (i * 7) % 11, i % 5, i % 3, i % 2, 300 + 13 * i) for i in range(n)]
    return spark.createDataFrame(rows, "player_id long, player_name string, team string, league string, season string, season_start_year int, "
                                 "position string, appearances long, fouls long, fouls_drawn long, yellow_cards long, red_cards long, minutes long")


def test_all_features_come_from_rows_materialised_once(spark):
    selected, _, state, keep = FE.create_all_features(_seasons(spark), "fouls", 20)
    plan = selected._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert selected.count() == 60 and len(keep) == 20


def test_scaler_and_scores_are_narrow_aggregates(spark):
    df = _seasons(spark).withColumn("gap", F.when(F.col("player_id") == 3, None).otherwise(F.col("fouls_drawn") * 1.0))
    cols = ["fouls_drawn", "minutes", "gap"]
    state = FE.fit_scaler(df, cols)
    want = df.agg(*[f(c).alias(f"{c}__{s}") for c in cols for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))]).first()
    got = state.first()
    assert state.columns == [f"{c}__{s}" for c in cols for s in ("mean", "std")]
    assert all(abs(got[c] - want[c]) < 1e-9 for c in state.columns)
    assert "stddev_pop(cast(minutes" not in state._jdf.queryExecution().optimizedPlan().toString()
    scores = {r.feature: r for r in FE.feature_scores(df, "fouls", cols).collect()}
    for c in cols:
        r2 = df.agg(F.regr_r2("fouls", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))).first()[0]
        assert abs(scores[c].f_score - r2 * 58 / (1 - r2)) < 1e-5
    assert sorted(r["rank"] for r in scores.values()) == [1, 2, 3]
    assert [r.f_score for r in FE.feature_scores(df.limit(0), "fouls", cols).collect()] == [0.0, 0.0, 0.0]


def test_block_sums_are_few_columns(spark, monkeypatch):
    rows = [(i % 3 if i != 5 else None, float(i), None if i == 7 else i * i % 13 * 1.0, i * 0.5 - 3) for i in range(40)]
    df = spark.createDataFrame(rows, "block int, a double, b double, y double").repartition(4)
    sums, plain = [], F.sum
    monkeypatch.setattr(TU.F, "sum", lambda c: (sums.append(c), plain(c))[1])
    got = TU.block_sums(df, ["a", "b"], "y")
    assert len(sums) == 1
    for k in range(3):
        z = np.array([r[1:] for r in rows if r[0] == k and r[2] is not None])
        x, y = z[:, :2], z[:, 2]
        s = got[k]
        assert s.n == len(z) and np.allclose(s.xx, x.T @ x) and np.allclose(s.xy, x.T @ y)
        assert np.allclose([*s.x, s.y, s.yy], [*x.sum(0), y.sum(), y @ y])
    assert sum(s.n for s in got.values()) == 39
    assert TU.block_sums(df.limit(0), ["a", "b"], "y") == {}


def test_boosted_fits_keep_no_node_ids(spark):
    rows = [(float(i % 7), float(i * i % 11), float(i % 7 + i * i % 11 % 3)) for i in range(200)]
    df = _vectors(spark, rows)
    for kind in ("xgboost", "gradient_boosting"):
        est = PR.regressor(kind, "red_cards").setMaxIter(4)
        assert not est.getCacheNodeIds()
        kept = est.copy().setCacheNodeIds(True).fit(df)
        trees = lambda m: m.toDebugString.split("\n", 1)[1]  # noqa: E731  the first line is the model's own id
        assert trees(est.fit(df)) == trees(kept)


def _vectors(spark, rows):
    from fairplay.operators.cluster import assemble

    return assemble(spark.createDataFrame(rows, "a double, b double, label double").coalesce(2), ["a", "b"])
