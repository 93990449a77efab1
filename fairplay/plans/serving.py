"""Models saved with all that they need of their features, and used again.

A target's saved form is one pipeline: missing values, the encoder of positions, the
feature list (an assembler), the scaler, the selection and the regressor, each a stage
with its own read and write. Scoring loads it and gives it plain look-back rows, so a
later session needs neither the training rows nor the order of the features.

Cases: a position that training did not see gets a code of its own; missing features
count as 0; a player without earlier games is scored on zeros; players without a
profile have no cluster (null); an empty table gives an empty report.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairplay.operators import cluster as CL
from fairplay.operators import features as FE
from fairplay.operators import predict as PR
from fairplay.plans.training import LOOKBACK_FEATURES
from fairplay.plans.windows import top_k_per_group
from fairplay.session import cut_lineage, ensure_checkpoint_dir
from fairplay.sources import tables as TB
from fairplay.sources.sinks import load_pipeline_model, save_model

FEATURES = [*LOOKBACK_FEATURES, "position_code"]


def feature_stages(chosen: int) -> Pipeline:
    """Missing values, encoder, feature list, scaler and selection; ``label`` is the target."""
    filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0D) AS f_{c}" for c in LOOKBACK_FEATURES)
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {filled}, coalesce(position, '') AS f_position FROM __THIS__"),
        StringIndexer(inputCol="f_position", outputCol="f_position_code", handleInvalid="keep", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="f_all"),
        StandardScaler(inputCol="f_all", outputCol="f_scaled", withMean=True, withStd=True),
        UnivariateFeatureSelector(featuresCol="f_scaled", outputCol="features", labelCol="label", selectionMode="numTopFeatures")
        .setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(chosen)])


def fit_all(train: DataFrame, kind: str = "linear", targets: Sequence[str] = PR.TARGETS, chosen: int = 10) -> dict[str, PipelineModel]:
    """A pipeline per target, fitted on look-back rows (with ``target_<name>`` columns).

    Only the selection and the regressor depend on the target: the stages before are fitted
    once, and their scaled features are materialised for all targets.
    """
    *shared, selector = feature_stages(chosen).getStages()
    base = Pipeline(stages=shared).fit(train)
    scaled = cut_lineage(base.transform(train).select("f_scaled", *[F.col(f"target_{t}").cast("double") for t in targets]))
    out = {}
    for t in targets:
        data = scaled.select("f_scaled", F.col(f"target_{t}").alias("label"))
        chooser = selector.fit(data)
        model = PR.fit(kind, t, chooser.transform(data).select("features", "label"))
        out[t] = PipelineModel([*base.stages, chooser, model.setPredictionCol(f"raw_{t}")])
    return out


def save_all(models: dict[str, PipelineModel], path: str) -> None:
    for t, model in models.items():
        save_model(model, f"{path}/{t}")


def load_all_models(path: str, targets: Sequence[str] = PR.TARGETS) -> dict[str, PipelineModel]:
    return {t: load_pipeline_model(f"{path}/{t}") for t in targets}


def score(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """``rows`` with ``pred_<target>`` (not negative) of every model; other columns stay as they are."""
    kept = rows.columns
    for t, model in models.items():
        rows = model.transform(rows).withColumn(f"pred_{t}", PR.non_negative(f"raw_{t}"))
        kept = [*kept, f"pred_{t}"]
        rows = rows.select(*kept)
    return rows


def latest_rows(pm: DataFrame, lookback: int = 10, rows: DataFrame | None = None) -> DataFrame:
    """The look-back row of every player's last game (two-stage, so a busy player is many tasks);
    ``rows``: the look-back rows of ``pm``, if they are at hand."""
    rows = FE.lookback_features(pm, lookback) if rows is None else rows
    order = [F.col("match_date").desc(), F.col("match_id").desc()]
    return top_k_per_group(rows, ["player_id"], order, 1, ["match_id"], name="_last").drop("_last")


def fitted_player_risk(models: dict[str, PipelineModel], pm: DataFrame, clusters: DataFrame | None = None, lookback: int = 10,
                       rows: DataFrame | None = None) -> DataFrame:
    """Every player's predictions by fitted models, graded (M17-M19), with the cluster."""
    scored = score(models, latest_rows(pm, lookback, rows))
    cols = {}
    for t in PR.TARGETS:
        p = F.col(f"pred_{t}")
        cols |= {f"{t}_risk": PR.risk_level(p, t), f"{t}_percentile": PR.step_percentile(p, t)}
    cols["overall_score"], cols["overall_risk"] = PR.overall_risk({t: F.col(f"pred_{t}") for t in PR.TARGETS})
    out = scored.withColumns(cols).select(
        "player_id", "player_name", "position", "team", F.col(f"games_in_form_{lookback}").alias("recent_games"),
        F.col("match_date").alias("last_game_date"), *[f"pred_{t}" for t in PR.TARGETS], *cols)
    if clusters is None:
        return out
    return out.join(clusters.select(F.col("id").alias("player_id"), F.col("prediction").alias("cluster")), "player_id", "left")


def train_rows(pm: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    rows = FE.lookback_features(pm, 10) if rows is None else rows
    return PR.time_split(rows, "match_date", ["match_id"]).where(F.col("split") == "train").drop("_pos")


def fit_save_load_and_grade(spark: SparkSession, sf_dir: str, vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole way: fit, save, load, score the last games, grade, join the nearest cluster.

    The look-back rows are made once, for the training and for the last games.
    """
    pm = cut_lineage(TB.player_match(spark, sf_dir))
    rows = cut_lineage(FE.lookback_features(pm, 10))
    path = f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    save_all(fit_all(cut_lineage(train_rows(pm, rows))), path)
    return fitted_player_risk(load_all_models(path), pm, CL.assign_to_clusters(vectors, vectors, labels), rows=rows)
