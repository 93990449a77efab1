"""Prediction, evaluation and risk grading.

Model fits use MLlib estimators on one cached training frame. The
evaluation side (metrics, clamp, ensemble, best model, splits, risk bands,
player report) is plain DataFrame code, so it also runs on any prediction
table; the registered jobs use deterministic stand-in member models (the
trailing 3/5/10-game form of each player) to make them checkable in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairplay.functions.numeric import step_band
from fairplay.operators import forest as FO
from fairplay.plans.windows import ordered_index, top_k_per_group

# Fixed values (must equal the reference's for equal results).
TARGETS = ["fouls", "yellow_cards", "red_cards"]
MODELS = ["xgboost", "random_forest", "gradient_boosting"]
ENSEMBLE_WEIGHTS = {"xgboost": 0.5, "random_forest": 0.3, "gradient_boosting": 0.2}
RISK_THRESHOLDS = {"fouls": (1.0, 2.0, 3.0), "yellow_cards": (0.2, 0.5, 1.0),
                   "red_cards": (0.05, 0.1, 0.2)}
STEP_PERCENTILES = {
    "fouls": [(0.5, 25), (1.0, 50), (1.5, 75), (2.0, 85), (3.0, 95)],
    "yellow_cards": [(0.1, 25), (0.3, 50), (0.5, 75), (0.8, 85), (1.2, 95)],
    "red_cards": [(0.02, 25), (0.05, 50), (0.08, 75), (0.12, 85), (0.2, 95)],
}
OVERALL_WEIGHTS = {"fouls": 0.4, "yellow_cards": 0.4, "red_cards": 0.2}
OVERALL_CUTS = (1.0, 2.0, 3.0)
BOOSTED_MAIN = {  # target -> (trees, depth, rate, row sample)
    "fouls": (200, 6, 0.1, 0.8), "yellow_cards": (150, 5, 0.1, 0.8), "red_cards": (100, 4, 0.15, 0.9)}
FOREST = {"fouls": (100, 10, 2), "yellow_cards": (100, 8, 2), "red_cards": (80, 6, 3)}
BOOSTED_SECOND = {
    "fouls": (150, 5, 0.1, 0.8), "yellow_cards": (120, 4, 0.1, 0.8), "red_cards": (100, 3, 0.15, 0.9)}
LINEAR_ALPHA = {"fouls": ("ridge", 1.0), "yellow_cards": ("ridge", 1.5), "red_cards": ("lasso", 0.1)}
STANDIN_WINDOWS = {"xgboost": 3, "random_forest": 5, "gradient_boosting": 10}


# ---------------------------------------------------------------- stand-in members
def standin_predictions(pm: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Per (player, match) and model: the mean of the previous n games (n = 3/5/10).

    Deterministic member "models" for checking the evaluation operators;
    one window spec, so one shuffle and one sort for all of them.
    """
    base = Window.partitionBy("player_id").orderBy("match_date", "match_id")
    cols = {}
    for model, n in STANDIN_WINDOWS.items():
        frame = base.rowsBetween(-n, -1)
        for t in targets:
            cols[f"pred_{model}_{t}"] = F.avg(F.col(t).cast("double")).over(frame)
    return pm.withColumns(cols)


# ---------------------------------------------------------------- M8, M9, M11
def regression_metrics(df: DataFrame, y: str, yhat: str, group: Sequence[str] = ()) -> DataFrame:
    """M8: rmse, mae, r2, mse, means, std_actual (ddof 1), std_predicted (ddof 0)."""
    yy, pp = F.col(y).cast("double"), F.col(yhat).cast("double")
    err = pp - yy
    g = df.where(yy.isNotNull() & pp.isNotNull())
    aggs = [F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
            (1 - F.try_divide(F.sum(err * err), F.var_pop(yy) * F.count(F.lit(1)))).alias("r2"),
            F.avg(err * err).alias("mse"), F.avg(yy).alias("mean_actual"),
            F.avg(pp).alias("mean_predicted"), F.stddev_samp(yy).alias("std_actual"),
            F.stddev_pop(pp).alias("std_predicted"), F.count(F.lit(1)).alias("samples")]
    return (g.groupBy(*group) if group else g.groupBy()).agg(*aggs)


def non_negative(c: str | Column) -> Column:
    """M9: max(prediction, 0)."""
    return F.greatest(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def ensemble(cols: dict[str, Column], weights: dict[str, float] = ENSEMBLE_WEIGHTS) -> Column:
    """Weighted mean over the members present (null members skipped, weights renormalised)."""
    if set(cols) - set(weights):
        raise ValueError("number of models and weights must match")
    num = None
    den = None
    for m, c in cols.items():
        w = F.lit(float(weights[m]))
        term = F.when(c.isNotNull(), c * w).otherwise(F.lit(0.0))
        wt = F.when(c.isNotNull(), w).otherwise(F.lit(0.0))
        num = term if num is None else num + term
        den = wt if den is None else den + wt
    return F.when(den > 0, num / den)


# ---------------------------------------------------------------- M13, M14
def average_importance(importances: DataFrame) -> DataFrame:
    """(model, feature, importance) -> mean over models, a missing feature counts 0."""
    n_models = importances.select("model").distinct().count()
    return (importances.groupBy("feature").agg((F.sum("importance") / F.lit(n_models)).alias("importance"))
            .orderBy(F.col("importance").desc(), "feature"))


def best_model(evaluation: DataFrame, metric: str = "rmse") -> DataFrame:
    """Per target the model with the lowest test metric."""
    return evaluation.groupBy("target").agg(
        F.min_by("model", F.struct(metric, "model")).alias("best_model"),
        F.min(metric).alias(f"best_{metric}"))


# ---------------------------------------------------------------- M15, M16
def time_split(df: DataFrame, date_col: str, key_cols: Sequence[str], test: float = 0.2,
               validation: float = 0.1) -> DataFrame:
    """train = first int(n x (1 - test - val)) rows by date, then val, test = the rest.

    The global position comes from range counts + offsets (no single-partition sort).
    """
    idx = ordered_index(df, [], [date_col, *key_cols], name="_pos")
    n = idx.agg(F.count(F.lit(1)).alias("_n"))
    from fairplay.operators.queries import attach_scalar

    x = attach_scalar(idx, n)
    test_start = F.floor(F.col("_n") * (1 - test))
    val_start = F.floor(F.col("_n") * (1 - test - validation))
    split = (F.when(F.col("_pos") <= val_start, "train").when(F.col("_pos") <= test_start, "val")
             .otherwise("test"))
    return x.withColumn("split", split).drop("_n")


def random_split(df: DataFrame, key_cols: Sequence[str], test: float = 0.2,
                 validation: float = 0.1, seed: int = 42) -> DataFrame:
    """Repeatable split from a hash of the key (same rows under any partitioning):
    test share ``test``, then validation ``validation / (1 - test)`` of the rest."""
    b = F.pmod(F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed)), F.lit(10000)) / 10000.0
    b2 = F.pmod(F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed + 1)), F.lit(10000)) / 10000.0
    split = (F.when(b < test, "test").when(b2 < validation / (1 - test), "val").otherwise("train"))
    return df.withColumn("split", split)


# ---------------------------------------------------------------- M17-M19
def risk_level(pred: str | Column, target: str) -> Column:
    """<= low -> low, <= medium -> medium, <= high -> high, else very_high."""
    lo, mid, hi = RISK_THRESHOLDS[target]
    return step_band(pred, [(lo, "low"), (mid, "medium"), (hi, "high")], "very_high",
                     inclusive_upper=True)


def step_percentile(pred: str | Column, target: str) -> Column:
    """First threshold >= value gives 25/50/75/85/95, else 99; unknown target 50."""
    if target not in STEP_PERCENTILES:
        return F.lit(50.0)
    v = F.col(pred) if isinstance(pred, str) else pred
    expr = None
    for cut, pct in STEP_PERCENTILES[target]:
        expr = (F.when(v <= cut, F.lit(float(pct))) if expr is None
                else expr.when(v <= cut, F.lit(float(pct))))
    return expr.otherwise(F.lit(99.0))


def overall_risk(preds: dict[str, Column]) -> tuple[Column, Column]:
    """0.4 fouls + 0.4 yellow + 0.2 red; bands at 1, 2, 3."""
    score = None
    for t, w in OVERALL_WEIGHTS.items():
        term = preds[t] * w
        score = term if score is None else score + term
    lo, mid, hi = OVERALL_CUTS
    return score, step_band(score, [(lo, "low"), (mid, "medium"), (hi, "high")], "very_high",
                            inclusive_upper=True)


def player_risk(pm: DataFrame, lookback: int = 10, labels: DataFrame | None = None) -> DataFrame:
    """M20 for every player in one job: the last ``lookback`` games give the
    prediction (their mean per target, the stand-in model), then M17-M19 and
    the player's latest name, position, team, games used and last date.

    The last games per player come from a salted two-stage top-k, so one very
    active player is not sorted in a single task.
    """
    recent = top_k_per_group(pm, ["player_id"], [F.col("match_date").desc(), F.col("match_id").desc()],
                             lookback, ["match_id"], name="_recent")
    agg = recent.groupBy("player_id").agg(
        *[F.avg(F.col(t).cast("double")).alias(f"pred_{t}") for t in TARGETS],
        F.max_by("player_name", F.struct("match_date", "match_id")).alias("player_name"),
        F.max_by("position", F.struct("match_date", "match_id")).alias("position"),
        F.max_by("team", F.struct("match_date", "match_id")).alias("team"),
        F.count(F.lit(1)).alias("recent_games"),
        F.max("match_date").alias("last_game_date"))
    cols = {}
    for t in TARGETS:
        p = F.col(f"pred_{t}")
        cols[f"{t}_risk"] = risk_level(p, t)
        cols[f"{t}_percentile"] = step_percentile(p, t)
    score, level = overall_risk({t: F.col(f"pred_{t}") for t in TARGETS})
    cols["overall_score"] = score
    cols["overall_risk"] = level
    out = agg.withColumns(cols)
    if labels is not None:
        out = out.join(labels.select(F.col("id").alias("player_id"), F.col("label").alias("cluster")),
                       "player_id", "left")
    return out


# ---------------------------------------------------------------- M1-M7, M10, M12
def regressor(kind: str, target: str, features: str = "features", label: str = "label"):
    """M1-M5 estimators with the per-target settings.

    Boosted trees are shallow: walking a row down from the root is cheaper than a table of
    node ids that every level writes anew, so none is kept.
    """
    if kind == "xgboost":
        trees, depth, rate, sub = BOOSTED_MAIN[target]
        return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=sub,
                            featureSubsetStrategy="0.8", featuresCol=features, labelCol=label, seed=42)
    if kind == "gradient_boosting":
        trees, depth, rate, sub = BOOSTED_SECOND[target]
        return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=sub,
                            featuresCol=features, labelCol=label, seed=42)
    if kind == "random_forest":
        trees, depth, leaf = FOREST[target]
        return RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, maxMemoryInMB=1024,
                                     featuresCol=features, labelCol=label, seed=42)
    if kind == "linear":
        form, alpha = LINEAR_ALPHA[target]
        if form == "ridge":
            # Matches the ridge closed form when regParam = alpha * std(y) / n.
            return ("ridge", alpha)
        return LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False,
                                featuresCol=features, labelCol=label)
    raise ValueError(kind)


def fit(kind: str, target: str, train: DataFrame, features: str = "features", label: str = "label"):
    est = regressor(kind, target, features, label)
    if isinstance(est, tuple):
        _, alpha = est
        st = train.agg(F.stddev_samp(label).alias("s"), F.count(F.lit(1)).alias("n")).first()
        reg = alpha * (st["s"] or 1.0) / max(st["n"], 1)
        est = LinearRegression(elasticNetParam=0.0, regParam=reg, standardization=False,
                               featuresCol=features, labelCol=label)
    return est.fit(train)


def grow_forests(train: DataFrame, targets: Sequence[str], features: str = "features", seed: int = 42) -> dict[str, FO.ForestModel]:
    """M2 of all targets at once, for many rows: every level of all trees is one job over rows kept as bins.

    The settings are those of ``regressor``; a third of the features are candidates of a split.
    """
    size = len(train.select(features).first()[0])
    specs = [(t, FO.Spec(i, (seed + i) * 10_000 + k, depth, (leaf,), -(-size // 3)))
             for i, t in enumerate(targets) for trees, depth, leaf in [FOREST[t]] for k in range(trees)]
    grown = FO.grow(train, [f"target_{t}" for t in targets], [s for _, s in specs], features)
    return {t: FO.ForestModel([trees[0] for (of, _), trees in zip(specs, grown, strict=True) if of == t], size, features) for t in targets}


def predict_non_negative(model, df: DataFrame, out: str = "prediction") -> DataFrame:
    """M9 applied to a fitted model's output."""
    return model.transform(df).withColumn(out, non_negative("prediction"))


def predict_all(models: dict[str, object], df: DataFrame) -> DataFrame:
    """Three targets on one frame; an untrained target predicts 0; adds total cards
    and discipline points."""
    out = df
    for t in TARGETS:
        m = models.get(t)
        if m is None:
            out = out.withColumn(f"pred_{t}", F.lit(0.0))
        else:
            out = (m.setPredictionCol(f"_p_{t}").transform(out)
                   .withColumn(f"pred_{t}", non_negative(f"_p_{t}")).drop(f"_p_{t}"))
    return out.withColumns({
        "pred_total_cards": F.col("pred_yellow_cards") + F.col("pred_red_cards"),
        "pred_discipline_points": F.col("pred_yellow_cards") + 2 * F.col("pred_red_cards")})


def importance(model, feature_names: Sequence[str], k: int = 20) -> list[tuple[str, float]]:
    """Top-k feature importances (model-size, read from the fitted model)."""
    imp = model.featureImportances.toArray()
    pairs = sorted(zip(feature_names, imp), key=lambda p: (-p[1], p[0]))
    return [(f, float(v)) for f, v in pairs[:k]]
