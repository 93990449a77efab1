"""Experiment store as tables (runs, run_metrics, run_params, run_tags,
model_versions). Every operation is a join or aggregate over those tables;
"latest" and "best" choices are ``max_by``/``min_by`` aggregates, and the
only top-k (newest runs) is bounded by its k.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairplay.plans.joins import bounded_broadcast
from fairplay.plans.windows import ordered_index, top_k_per_group
from fairplay.session import cut_lineage

METRIC_PARTS = ("train", "val", "best")
TOP_FEATURES = 10
STORE = ("runs", "run_metrics", "run_params", "run_tags", "model_versions")


# ---------------------------------------------------------------- T1
def metric_rows(spark: SparkSession, run_id: str, metrics: Mapping[str, object]) -> DataFrame:
    """Numeric metrics only (bool excluded), as (run_id, key, value) rows."""
    rows = [(run_id, k, float(v)) for k, v in metrics.items()
            if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "run_id string, key string, value double")


def log_run(spark: SparkSession, root: str, run: Mapping[str, object],
            metrics: Mapping[str, object], params: Mapping[str, object] | None = None,
            tags: Mapping[str, str] | None = None) -> None:
    """Append one run and its metrics, params and tags to the tables under ``root``."""
    rid = str(run["run_id"])
    spark.createDataFrame(
        [(rid, run.get("experiment"), run.get("name"), run.get("status", "FINISHED"),
          run.get("start_time"), run.get("end_time"))],
        "run_id string, experiment string, name string, status string, start_time timestamp, "
        "end_time timestamp").write.mode("append").parquet(f"{root}/runs")
    metric_rows(spark, rid, metrics).write.mode("append").parquet(f"{root}/run_metrics")
    for name, kv in (("run_params", params or {}), ("run_tags", tags or {})):
        spark.createDataFrame([(rid, str(k), str(v)) for k, v in kv.items()],
                              "run_id string, key string, value string") \
            .write.mode("append").parquet(f"{root}/{name}")


def log_runs(runs: DataFrame, root: str, metrics: DataFrame, params: DataFrame | None = None,
             tags: DataFrame | None = None) -> None:
    """T1 for many runs: one append per table (not one file set per run). ``metrics`` holds
    (run_id, key, value); values that are no numbers are left out."""
    runs.write.mode("append").parquet(f"{root}/runs")
    numeric = metrics.select("run_id", "key", F.col("value").try_cast("double").alias("value")).where(F.col("value").isNotNull())
    numeric.write.mode("append").parquet(f"{root}/run_metrics")
    for name, kv in (("run_params", params), ("run_tags", tags)):
        if kv is not None:
            kv.select("run_id", "key", F.col("value").cast("string").alias("value")).write.mode("append").parquet(f"{root}/{name}")


def training_records(fits: DataFrame, scores: DataFrame, importances: DataFrame,
                     stored_versions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The store's rows (by table name) for many finished fits.

    ``fits``: run_id, experiment, model, target, start_time, end_time, n_features,
    n_train_samples, n_val_samples. ``scores``: run_id, part (train, val or best), key,
    value. ``importances``: run_id, feature, importance.

    Metrics are ``<part>_<key>`` (numbers only, other parts are left out) and
    ``feature_importance_<i>`` of the ten largest (ties by name), whose names are the
    params ``top_feature_<i>``. Every fit is a new version of its (model, target), in order
    of (end_time, run_id) behind the stored ones. A null sample count is no param.
    """
    runs = fits.select("run_id", "experiment", F.concat_ws("_", "model", "target").alias("name"),
                       F.lit("FINISHED").alias("status"), "start_time", "end_time")
    kept = scores.where(F.col("part").isin(*METRIC_PARTS)).select(
        "run_id", F.concat_ws("_", "part", "key").alias("key"), F.col("value").try_cast("double").alias("value"))
    top = cut_lineage(top_k_per_group(importances.where(F.col("importance").isNotNull()), ["run_id"],
                                      [F.col("importance").desc(), F.col("feature")], TOP_FEATURES, ["feature"], name="_i"))  # metrics and params read it
    metrics = kept.where(F.col("value").isNotNull()).unionByName(top.select(
        "run_id", F.concat(F.lit("feature_importance_"), F.col("_i")).alias("key"), F.col("importance").cast("double").alias("value")))

    def pairs(**values) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
        return fits.select("run_id", F.inline(entries)).where(F.col("value").isNotNull())

    params = pairs(model_type=F.col("model"), target=F.col("target"), n_features=F.col("n_features"),
                   n_train_samples=F.col("n_train_samples"), n_val_samples=F.col("n_val_samples"))
    params = params.unionByName(top.select("run_id", F.concat(F.lit("top_feature_"), F.col("_i")).alias("key"), F.col("feature").alias("value")))
    tags = pairs(model_category=F.lit("prediction"), target_variable=F.col("target"), algorithm=F.col("model"),
                 training_date=F.date_format("end_time", "yyyy-MM-dd"))
    new = ordered_index(fits.select("model", "target", "run_id", F.col("end_time").alias("created")),
                        ["model", "target"], ["created", "run_id"], name="version")
    if stored_versions is not None:
        last = stored_versions.groupBy(F.col("model").alias("_m"), F.col("target").alias("_t")).agg(F.max("version").alias("_last"))
        same = F.col("model").eqNullSafe(F.col("_m")) & F.col("target").eqNullSafe(F.col("_t"))
        new = new.join(bounded_broadcast(last), same, "left").withColumn("version", F.col("version") + F.coalesce("_last", F.lit(0)))
    versions = new.select("model", "target", F.col("version").cast("int").alias("version"), F.lit("None").alias("stage"),
                          "run_id", "created", F.col("created").alias("updated"))
    return dict(zip(STORE, (runs, metrics, params, tags, versions), strict=True))


def log_training(spark: SparkSession, root: str, fits: DataFrame, scores: DataFrame, importances: DataFrame) -> None:
    """Append the records of ``fits`` to the store under ``root``, versions behind the stored ones."""
    from fairplay.sources.sinks import stored_table

    stored = stored_table(spark, f"{root}/model_versions", {})
    records = training_records(fits, scores, importances, stored)
    versions = cut_lineage(records["model_versions"])  # read before the table that it counts from grows
    log_runs(records["runs"], root, records["run_metrics"], records["run_params"], records["run_tags"])
    versions.write.mode("append").parquet(f"{root}/model_versions")


# ---------------------------------------------------------------- T2-T4
def _with_metric(versions: DataFrame, metrics: DataFrame, metric: str) -> DataFrame:
    m = metrics.where(F.col("key") == metric).select("run_id", F.col("value").alias("metric_value"))
    return versions.join(m, "run_id")


def best_version(versions: DataFrame, metrics: DataFrame, metric: str = "val_rmse",
                 stage: str | None = "Production") -> DataFrame:
    """Per (model, target) the version with the minimum metric (always minimum)."""
    v = versions if not stage else versions.where(F.col("stage") == stage)
    j = _with_metric(v, metrics, metric)
    return j.groupBy("model", "target").agg(
        F.min_by("version", F.struct("metric_value", "version")).alias("version"),
        F.min("metric_value").alias("metric_value"))


def promote(versions: DataFrame, model: str, target: str, version: int, stage: str,
            now: str) -> DataFrame:
    """Set the stage of one version (an update on the version key)."""
    hit = (F.col("model") == model) & (F.col("target") == target) & (F.col("version") == version)
    return versions.withColumns({
        "stage": F.when(hit, F.lit(stage)).otherwise(F.col("stage")),
        "updated": F.when(hit, F.to_timestamp(F.lit(now))).otherwise(F.col("updated")),
    })


def compare(versions: DataFrame, metrics: DataFrame, models: Sequence[str], target: str,
            metric_keys: Sequence[str] = ("val_rmse", "val_mae", "val_r2")) -> DataFrame:
    """T4: latest version (numeric max) per model, one column per metric (missing null)."""
    latest = (versions.where(F.col("model").isin(list(models)) & (F.col("target") == target))
              .groupBy("model").agg(F.max_by(F.struct("version", "run_id", "stage"), "version")
                                    .alias("v"))
              .select(F.col("model").alias("model_name"), "v.version", "v.run_id", "v.stage"))
    m = metrics.where(F.col("key").isin(list(metric_keys)))
    wide = (m.join(latest.select("run_id"), "run_id", "left_semi")
            .groupBy("run_id").pivot("key", list(metric_keys)).agg(F.first("value")))
    out = latest.join(wide, "run_id", "left")
    return out.orderBy(F.col(metric_keys[0]).asc_nulls_last(), "model_name")


# ---------------------------------------------------------------- T5-T9
def retain(runs: DataFrame, max_runs: int = 100, older_than_days: int = 30,
           now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """T5: (kept, deleted). Deleted = older than the cutoff or beyond the newest max_runs.

    The newest max_runs are a top-k (k rows per task, then k at the driver);
    ``now`` is a parameter (default: the newest start time).
    """
    if now is None:
        anchor = runs.agg(F.max("start_time").alias("_now"))
    else:
        anchor = runs.sparkSession.range(1).select(F.to_timestamp(F.lit(now)).alias("_now"))
    newest = runs.orderBy(F.col("start_time").desc(), F.col("run_id").desc()).limit(max_runs)
    cutoff = anchor.select((F.col("_now") - F.make_dt_interval(days=F.lit(older_than_days)))
                           .alias("_cutoff"))
    from fairplay.operators.queries import attach_scalar

    recent = attach_scalar(runs, cutoff).where(F.col("start_time") >= F.col("_cutoff")).drop("_cutoff")
    kept = recent.join(F.broadcast(newest.select("run_id")), "run_id", "left_semi")
    deleted = runs.join(kept.select("run_id"), "run_id", "left_anti")
    return kept, deleted


def experiment_summary(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Run totals by status, registered models, models by stage (one row)."""
    r = runs.agg(F.count(F.lit(1)).alias("total_runs"),
                 F.count_if(F.col("status") == "FINISHED").alias("finished_runs"),
                 F.count_if(F.col("status") == "RUNNING").alias("running_runs"),
                 F.count_if(F.col("status") == "FAILED").alias("failed_runs"))
    v = versions.agg(
        F.count_distinct("model", "target").alias("registered_models"),
        F.count_distinct(F.when(F.col("stage") == "Production", F.struct("model", "target")))
        .alias("production_models"),
        F.count_distinct(F.when(F.col("stage") == "Staging", F.struct("model", "target")))
        .alias("staging_models"),
        F.count_distinct(F.when(F.col("stage") == "Archived", F.struct("model", "target")))
        .alias("archived_models"))
    from fairplay.operators.queries import attach_scalar

    return attach_scalar(r, v)


def recent_runs(runs: DataFrame, metrics: DataFrame, k: int = 10, params: DataFrame | None = None,
                tags: DataFrame | None = None) -> DataFrame:
    """Newest k runs with their metrics (and params and tags, where given) as maps (k <= 100)."""
    if not 1 <= k <= 100:
        raise ValueError("k must be in 1..100")
    top = runs.orderBy(F.col("start_time").desc(), F.col("run_id").desc()).limit(k)
    out = top
    for name, kv in (("metrics", metrics), ("params", params), ("tags", tags)):
        if kv is None:
            continue
        m = kv.join(F.broadcast(top.select("run_id")), "run_id", "left_semi")  # k rows
        out = out.join(m.groupBy("run_id").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(name)), "run_id", "left")
    return out


def run_details(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Run rows with duration in seconds (null while running)."""
    out = runs if run_id is None else runs.where(F.col("run_id") == run_id)
    return out.withColumn("duration_seconds", F.when(
        F.col("end_time").isNotNull(),
        F.unix_timestamp("end_time") - F.unix_timestamp("start_time")))


def registry(versions: DataFrame) -> DataFrame:
    """Per (model, target, stage) the latest version."""
    return (versions.groupBy("model", "target", "stage")
            .agg(F.max_by(F.struct("version", "run_id", "created"), "version").alias("v"))
            .select("model", "target", "stage", "v.version", "v.run_id", "v.created"))
