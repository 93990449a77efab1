"""Saved pipelines give what the fitted ones give, and what a plain computation gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairplay.operators import cluster as CL
from fairplay.operators import features as FE
from fairplay.operators import predict as PR
from fairplay.plans import serving as SV
from fairplay.session import cut_lineage
from fairplay.sources import tables as TB
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def pm(spark):
    return cut_lineage(TB.player_match(spark, SF_SMALL))


@pytest.fixture(scope="module")
def fitted(pm):
    return SV.fit_all(cut_lineage(SV.train_rows(pm)))


def test_saved_models_score_alike(spark, pm, fitted, tmp_path):
    SV.save_all(fitted, str(tmp_path))
    loaded = SV.load_all_models(str(tmp_path))
    rows = SV.latest_rows(pm)
    new = rows.limit(3).withColumns({"position": F.lit("unseen"), "form_fouls_10": F.lit(None).cast("double")})
    for data in (rows, new):
        a, b = (sorted(map(tuple, SV.score(m, data).select("player_id", *[f"pred_{t}" for t in PR.TARGETS]).collect())) for m in (fitted, loaded))
        assert a == b and len(a) == data.count()


def test_predictions_equal_a_plain_computation(pm, fitted):
    rows = SV.latest_rows(pm).collect()
    got = {r["player_id"]: r for r in SV.score(fitted, SV.latest_rows(pm)).collect()}
    for t, model in fitted.items():
        _, indexer, assembler, scaler, selector, regressor = model.stages
        assert [c.removeprefix("f_") for c in assembler.getInputCols()] == SV.FEATURES
        codes = {p: i for i, p in enumerate(indexer.labels)}
        for r in rows[:25]:
            x = np.array([float(r[c] or 0) for c in SV.FEATURES[:-1]] + [codes[r["position"] or ""]])
            z = (x - scaler.mean.toArray()) / np.where(scaler.std.toArray() > 0, scaler.std.toArray(), np.inf)
            p = z[sorted(selector.selectedFeatures)] @ regressor.coefficients.toArray() + regressor.intercept
            assert got[r["player_id"]][f"pred_{t}"] == pytest.approx(max(0.0, p), abs=1e-9)


def test_one_graded_row_per_player(pm, fitted):
    report = SV.fitted_player_risk(fitted, pm).collect()
    last = {r["player_id"]: r["d"] for r in pm.groupBy("player_id").agg(F.max("match_date").alias("d")).collect()}
    assert {r["player_id"]: r["last_game_date"] for r in report} == last and len(report) == len(last)
    for r in report:
        total = sum(w * r[f"pred_{t}"] for t, w in PR.OVERALL_WEIGHTS.items())
        assert r["overall_score"] == pytest.approx(total)
        assert r["fouls_risk"] == ("low" if r["pred_fouls"] <= 1 else "medium" if r["pred_fouls"] <= 2 else "high" if r["pred_fouls"] <= 3 else "very_high")


def test_no_games_no_rows(pm, fitted):
    assert SV.fitted_player_risk(fitted, pm.limit(0)).count() == 0
    assert FE.lookback_features(pm.limit(0), 10).count() == 0


def test_lookback_rows_and_shared_stages_are_made_once(spark, monkeypatch):
    """m20_fitted_player_risk: one look-back, one fit of the stages that no target changes, one saved pipeline per target."""
    from pyspark.ml.feature import StandardScaler, StringIndexer

    calls = {"lookback": 0, "scaler": 0, "indexer": 0, "saved": 0}

    def counting(name, f):
        def g(*a, **k):
            calls[name] += 1
            return f(*a, **k)
        return g

    monkeypatch.setattr(SV.FE, "lookback_features", counting("lookback", SV.FE.lookback_features))
    monkeypatch.setattr(StandardScaler, "fit", counting("scaler", StandardScaler.fit))
    monkeypatch.setattr(StringIndexer, "fit", counting("indexer", StringIndexer.fit))
    monkeypatch.setattr(SV, "save_model", counting("saved", SV.save_model))
    pm = spark.range(400).selectExpr(
        "id % 20 AS player_id", "concat('p', id % 20) AS player_name", "id AS match_id", "timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id AS int)) AS match_date",
        "2020 AS season_start_year", "id % 4 AS team_id", "concat('t', id % 4) AS team", "'l' AS league", "elt(cast(id % 3 + 1 AS int), 'GK', 'DF', 'FW') AS position",
        "id % 4 AS home_team_id", "(id + 1) % 4 AS away_team_id", "1L AS appearances", "id * id % 7 AS fouls", "id % 5 AS fouls_drawn", "id % 3 AS yellow_cards",
        "id % 2 AS red_cards", "60 + id % 31 AS minutes_played")
    monkeypatch.setattr(SV.TB, "player_match", lambda *a: pm)
    vectors = CL.assemble(spark.range(20).selectExpr("id", "cast(id AS double) AS a"), ["a"])
    got = SV.fit_save_load_and_grade(spark, "", vectors, vectors.selectExpr("id", "cast(id % 2 AS int) AS label")).count()
    assert calls == {"lookback": 1, "scaler": 1, "indexer": 1, "saved": 3} and got == 20
