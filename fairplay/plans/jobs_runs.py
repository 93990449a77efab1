"""Registered experiment-store (T2-T9) and request-log (R1-R9) jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fairplay.operators import runs as RU
from fairplay.plans.catalog import job
from fairplay.plans.oracle import with_views
from fairplay.session import cut_lineage, ensure_checkpoint_dir
from fairplay.sources import tables as TB
from fairplay.streaming import admission as AD
from fairplay.streaming import live as LV

PROMOTE_AT = "2024-03-01 00:00:00"


def _mv(spark, sf_dir):
    return TB.model_versions_table(spark, sf_dir)


def _rm(spark, sf_dir):
    return TB.run_metrics_table(spark, sf_dir)


def _runs(spark, sf_dir):
    return TB.runs_table(spark, sf_dir)


RUNS = with_views("runs", "run_metrics", "model_versions")

_LOGGED = with_views("runs", "model_versions", extra={
    "fit": """SELECT r.run_id, r.experiment, v.model, v.target, r.start_time, r.end_time
  FROM runs r JOIN model_versions v ON r.run_id = v.run_id WHERE r.status = 'FINISHED'""",
    "ln": """SELECT f.run_id, 'line-' || CAST(l_linenumber AS VARCHAR) AS feature, sum(l_extendedprice) AS importance
  FROM lineitem JOIN fit f ON CAST(l_orderkey AS VARCHAR) = f.run_id GROUP BY ALL""",
    "top": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY importance DESC, feature) AS i FROM ln) x WHERE i <= 10""",
    "n": "SELECT run_id, count(*) AS nf FROM ln GROUP BY run_id",
    "lines": "SELECT CAST(l_orderkey AS VARCHAR) AS run_id, count(*) AS nl FROM lineitem GROUP BY 1",
    "ver": "SELECT *, row_number() OVER (PARTITION BY model, target ORDER BY end_time, run_id) AS version FROM fit"})


@job("t01_log_training", _LOGGED + """
SELECT 'runs' AS part, run_id, model || '_' || target AS key, CAST(NULL AS DOUBLE) AS number, 'FINISHED' AS text FROM fit
UNION ALL SELECT 'run_metrics', f.run_id, 'val_rmse', o_totalprice / 100000.0, NULL FROM fit f JOIN orders ON CAST(o_orderkey AS VARCHAR) = f.run_id
UNION ALL SELECT 'run_metrics', f.run_id, 'train_rmse', o_totalprice / 200000.0, NULL FROM fit f JOIN orders ON CAST(o_orderkey AS VARCHAR) = f.run_id
UNION ALL SELECT 'run_metrics', run_id, 'feature_importance_' || CAST(i AS VARCHAR), importance, NULL FROM top
UNION ALL SELECT 'run_params', run_id, 'top_feature_' || CAST(i AS VARCHAR), NULL, feature FROM top
UNION ALL SELECT 'run_params', run_id, 'model_type', NULL, model FROM fit
UNION ALL SELECT 'run_params', run_id, 'target', NULL, target FROM fit
UNION ALL SELECT 'run_params', f.run_id, 'n_features', NULL, CAST(nf AS VARCHAR) FROM fit f JOIN n ON f.run_id = n.run_id
UNION ALL SELECT 'run_params', f.run_id, 'n_train_samples', NULL, CAST(nl AS VARCHAR) FROM fit f JOIN lines ON f.run_id = lines.run_id
UNION ALL SELECT 'run_tags', run_id, 'model_category', NULL, 'prediction' FROM fit
UNION ALL SELECT 'run_tags', run_id, 'target_variable', NULL, target FROM fit
UNION ALL SELECT 'run_tags', run_id, 'algorithm', NULL, model FROM fit
UNION ALL SELECT 'run_tags', run_id, 'training_date', NULL, strftime(end_time, '%Y-%m-%d') FROM fit
UNION ALL SELECT 'model_versions', run_id, model || '_' || target, CAST(version AS DOUBLE), 'None' FROM ver""", doubles=["number"])
def t01_log_training(spark, sf_dir):
    """T1 written and read back: every finished run with prefixed scores, its lines' prices as
    importances (the ten largest), sample counts, tags and a version; in two batches by the
    middle end time, so the second's versions go on behind the first's."""
    lines = TB.read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), "l_linenumber", "l_extendedprice")
    importances = lines.groupBy("run_id", F.concat(F.lit("line-"), F.col("l_linenumber")).alias("feature")).agg(F.sum("l_extendedprice").alias("importance"))
    counts = lines.groupBy("run_id").agg(F.count_distinct("l_linenumber").alias("n_features"), F.count(F.lit(1)).alias("n_train_samples"))
    versions = _mv(spark, sf_dir).select("run_id", "model", "target")
    fits = _runs(spark, sf_dir).where(F.col("status") == "FINISHED").join(versions, "run_id").join(counts, "run_id", "left")
    fits = cut_lineage(fits.withColumn("n_val_samples", F.lit(None).cast("long")))  # every part of both batches reads it
    price = TB.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), "o_totalprice")
    scores = price.select("run_id", F.inline(F.array(*[
        F.struct(F.lit(part).alias("part"), F.lit(key).alias("key"), value.cast("string").alias("value")) for part, key, value in [
            ("val", "rmse", F.col("o_totalprice") / 100000.0), ("train", "rmse", F.col("o_totalprice") / 200000.0),
            ("val", "note", F.lit("no number")), ("other", "rmse", F.lit(1.0))]])))
    root = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    middle = fits.agg(F.expr("timestamp_seconds(unix_seconds(min(end_time)) div 2 + unix_seconds(max(end_time)) div 2)")).first()[0]
    for batch in (F.col("end_time") < F.lit(middle), F.col("end_time") >= F.lit(middle)):
        some = fits.where(batch)
        RU.log_training(spark, root, some, scores.join(some.select("run_id"), "run_id", "left_semi"),
                        importances.join(some.select("run_id"), "run_id", "left_semi"))
    t = {name: spark.read.parquet(f"{root}/{name}") for name in RU.STORE}
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    shape = {"runs": ("name", none, F.col("status")), "run_metrics": ("key", F.col("value"), text), "run_params": ("key", none, F.col("value")),
             "run_tags": ("key", none, F.col("value")), "model_versions": (F.concat_ws("_", "model", "target"), F.col("version").cast("double"), F.col("stage"))}
    out = None
    for name, (key, number, words) in shape.items():
        key = F.col(key) if isinstance(key, str) else key
        part = t[name].select(F.lit(name).alias("part"), "run_id", key.alias("key"), number.alias("number"), words.alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


@job("t02_best_version", RUNS + """
SELECT model, target, version, metric_value FROM (
  SELECT v.model, v.target, v.version, m.value AS metric_value,
         row_number() OVER (PARTITION BY v.model, v.target ORDER BY m.value, v.version) AS rn
  FROM model_versions v JOIN run_metrics m ON v.run_id = m.run_id
  WHERE v.stage = 'Production' AND m.key = 'val_rmse') x WHERE rn = 1""")
def t02_best_version(spark, sf_dir):
    return RU.best_version(_mv(spark, sf_dir), _rm(spark, sf_dir), "val_rmse", "Production")


@job("t03_promote", RUNS + f"""
SELECT model, target, version,
       CASE WHEN model = 'xgboost' AND target = 'fouls' AND version = 3 THEN 'Production' ELSE stage END AS stage,
       run_id, created,
       CASE WHEN model = 'xgboost' AND target = 'fouls' AND version = 3 THEN TIMESTAMP '{PROMOTE_AT}' ELSE updated END AS updated
FROM model_versions""")
def t03_promote(spark, sf_dir):
    return RU.promote(_mv(spark, sf_dir), "xgboost", "fouls", 3, "Production", PROMOTE_AT)


@job("t04_compare_models", RUNS + """
SELECT l.model_name, l.version, l.run_id, l.stage,
       max(m.value) FILTER (WHERE m.key = 'val_rmse') AS val_rmse,
       max(m.value) FILTER (WHERE m.key = 'val_mae') AS val_mae,
       CAST(max(m.value) FILTER (WHERE m.key = 'val_r2') AS DOUBLE) AS val_r2
FROM (SELECT model AS model_name, version, run_id, stage FROM (
        SELECT *, row_number() OVER (PARTITION BY model ORDER BY version DESC) AS rn
        FROM model_versions WHERE target = 'fouls') v WHERE rn = 1) l
LEFT JOIN run_metrics m ON l.run_id = m.run_id
GROUP BY l.model_name, l.version, l.run_id, l.stage""")
def t04_compare_models(spark, sf_dir):
    return RU.compare(_mv(spark, sf_dir), _rm(spark, sf_dir), list(TB.MODELS), "fouls")


_RETAIN = RUNS + """
, kept AS (
  SELECT * FROM runs
  WHERE start_time >= (SELECT max(start_time) FROM runs) - INTERVAL 30 DAY
    AND run_id IN (SELECT run_id FROM runs ORDER BY start_time DESC, run_id DESC LIMIT 100))
"""


@job("t05_retain_kept", _RETAIN + "SELECT * FROM kept")
def t05_retain_kept(spark, sf_dir):
    kept, _ = RU.retain(_runs(spark, sf_dir), 100, 30)
    return kept


@job("t05_retain_report", _RETAIN + """
SELECT (SELECT count(*) FROM runs) AS before, (SELECT count(*) FROM kept) AS after,
       (SELECT count(*) FROM runs) - (SELECT count(*) FROM kept) AS deleted""")
def t05_retain_report(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    kept, deleted = RU.retain(runs, 100, 30)
    from fairplay.operators.queries import attach_scalar

    before = runs.agg(F.count(F.lit(1)).alias("before"))
    after = kept.agg(F.count(F.lit(1)).alias("after"))
    gone = deleted.agg(F.count(F.lit(1)).alias("deleted"))
    return attach_scalar(attach_scalar(before, after), gone)


@job("t06_experiment_summary", RUNS + """
SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'FINISHED') AS finished_runs,
       count(*) FILTER (WHERE status = 'RUNNING') AS running_runs,
       count(*) FILTER (WHERE status = 'FAILED') AS failed_runs,
       (SELECT count(DISTINCT (model, target)) FROM model_versions) AS registered_models,
       (SELECT count(DISTINCT (model, target)) FROM model_versions WHERE stage = 'Production') AS production_models,
       (SELECT count(DISTINCT (model, target)) FROM model_versions WHERE stage = 'Staging') AS staging_models,
       (SELECT count(DISTINCT (model, target)) FROM model_versions WHERE stage = 'Archived') AS archived_models
FROM runs""")
def t06_experiment_summary(spark, sf_dir):
    return RU.experiment_summary(_runs(spark, sf_dir), _mv(spark, sf_dir))


@job("t07_recent_runs", RUNS + """
SELECT r.*, max(m.value) FILTER (WHERE m.key = 'val_rmse') AS val_rmse,
       max(m.value) FILTER (WHERE m.key = 'val_mae') AS val_mae, CAST(count(m.key) AS INTEGER) AS n_metrics
FROM (SELECT * FROM runs ORDER BY start_time DESC, run_id DESC LIMIT 10) r
LEFT JOIN run_metrics m ON r.run_id = m.run_id
GROUP BY ALL""")
def t07_recent_runs(spark, sf_dir):
    out = RU.recent_runs(_runs(spark, sf_dir), _rm(spark, sf_dir), 10)
    return out.select(*[c for c in out.columns if c != "metrics"],
                      F.col("metrics")["val_rmse"].alias("val_rmse"),
                      F.col("metrics")["val_mae"].alias("val_mae"),
                      F.size("metrics").alias("n_metrics"))


@job("t08_run_details", RUNS + """
SELECT *, CASE WHEN end_time IS NOT NULL THEN CAST(epoch(end_time) AS BIGINT) - CAST(epoch(start_time) AS BIGINT) END
          AS duration_seconds FROM runs""")
def t08_run_details(spark, sf_dir):
    return RU.run_details(_runs(spark, sf_dir))


@job("t09_registry", RUNS + """
SELECT model, target, stage, version, run_id, created FROM (
  SELECT *, row_number() OVER (PARTITION BY model, target, stage ORDER BY version DESC) AS rn
  FROM model_versions) x WHERE rn = 1""")
def t09_registry(spark, sf_dir):
    return RU.registry(_mv(spark, sf_dir))


# ---------------------------------------------------------------- R
REQ = with_views("requests")
OUR_ENDPOINT_LIMITS = {"signup": (3, 300), "purchase": (20, 60)}


def _req(spark, sf_dir):
    return TB.requests_log(spark, sf_dir)


@job("r01_fixed_window_counts", REQ + """
SELECT client, endpoint, date_trunc('hour', ts) AS window_start, count(*) AS requests
FROM requests GROUP BY ALL""")
def r01_fixed_window_counts(spark, sf_dir):
    return AD.fixed_window_counts(_req(spark, sf_dir), 3600)


@job("r01_fixed_window_decisions", REQ + """
SELECT event_id, ts, client, endpoint, window_start, position, position > 2 AS refused FROM (
  SELECT *, date_trunc('hour', ts) AS window_start,
         CAST(row_number() OVER (PARTITION BY client, endpoint, date_trunc('hour', ts) ORDER BY ts, event_id) AS INTEGER) AS position
  FROM requests) x""")
def r01_fixed_window_decisions(spark, sf_dir):
    d = AD.fixed_window_decisions(_req(spark, sf_dir), 2, 3600)
    return d.select("event_id", "ts", "client", "endpoint", "window_start", "position", "refused")


@job("r02_sliding_log", REQ + """
SELECT event_id, ts, client, endpoint, in_window, in_window > 2 AS refused FROM (
  SELECT *, count(*) OVER (PARTITION BY client, endpoint ORDER BY epoch_us(ts)
                           RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window
  FROM requests) x""")
def r02_sliding_log(spark, sf_dir):
    d = AD.sliding_log_decisions(_req(spark, sf_dir), 2, 3600)
    return d.select("event_id", "ts", "client", "endpoint", "in_window", "refused")


@job("r03_sliding_admission")
def r03_sliding_admission(spark, sf_dir):
    """R3 over the whole log (sequential per client; property-checked against a brute force)."""
    return AD.sliding_admission(_req(spark, sf_dir), limit=3, window_seconds=3600)


@job("r04_token_bucket")
def r04_token_bucket(spark, sf_dir):
    return AD.token_bucket(_req(spark, sf_dir), capacity=3, rate=1 / 1200)


@job("r05_resolve_limits", REQ + """
SELECT r.*, coalesce(e.lim, t.lim, 60) AS "limit", coalesce(e.win, t.win, 60) AS window_seconds
FROM requests r
LEFT JOIN (VALUES ('signup', 3, 300), ('purchase', 20, 60)) e(endpoint, lim, win) ON r.endpoint = e.endpoint
LEFT JOIN (VALUES ('free', 100, 3600), ('premium', 1000, 3600), ('enterprise', 10000, 3600)) t(tier, lim, win)
  ON r.tier = t.tier""")
def r05_resolve_limits(spark, sf_dir):
    return AD.resolve_limits(_req(spark, sf_dir), endpoint_limits=OUR_ENDPOINT_LIMITS)


_KEY_INPUT = """
  SELECT event_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN user_id END AS uid,
         CASE WHEN event_type IN ('view', 'click') THEN '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.'
              || CAST(event_id % 256 AS VARCHAR) || ', 172.16.0.1' END AS forwarded,
         CASE WHEN event_type <> 'error' THEN 'host-' || CAST(user_id AS VARCHAR) END AS host
  FROM events"""


@job("r06_client_key", with_views(extra={"ki": _KEY_INPUT}) + """
SELECT event_id, CASE WHEN uid IS NOT NULL THEN 'user:' || CAST(uid AS VARCHAR)
                      WHEN forwarded IS NOT NULL AND trim(split_part(forwarded, ',', 1)) <> ''
                        THEN 'ip:' || trim(split_part(forwarded, ',', 1))
                      WHEN host IS NOT NULL THEN 'ip:' || host ELSE 'unknown' END AS client
FROM ki""")
def r06_client_key(spark, sf_dir):
    ev = TB.read_table(spark, sf_dir, "events")
    t = F.col("event_type")
    ki = ev.select(
        "event_id",
        F.when(t.isin("purchase", "signup"), F.col("user_id")).alias("uid"),
        F.when(t.isin("view", "click"),
               F.concat(F.lit("10.0."), F.pmod("user_id", F.lit(256)).cast("string"), F.lit("."),
                        F.pmod("event_id", F.lit(256)).cast("string"), F.lit(", 172.16.0.1")))
        .alias("forwarded"),
        F.when(t != "error", F.concat(F.lit("host-"), F.col("user_id").cast("string"))).alias("host"))
    return ki.select("event_id", AD.client_key("uid", "forwarded", "host").alias("client"))


@job("r07_quota_status", REQ + """
, lim AS (
  SELECT r.*, coalesce(e.lim, t.lim, 60) AS lim, coalesce(e.win, t.win, 60) AS win
  FROM requests r
  LEFT JOIN (VALUES ('signup', 3, 300), ('purchase', 20, 60)) e(endpoint, lim, win) ON r.endpoint = e.endpoint
  LEFT JOIN (VALUES ('free', 100, 3600), ('premium', 1000, 3600), ('enterprise', 10000, 3600)) t(tier, lim, win)
    ON r.tier = t.tier),
now AS (SELECT TIMESTAMP '2024-01-30 23:00:00' AS now)
SELECT client, endpoint, lim AS "limit", used, greatest(0, lim - used) AS remaining,
       CASE WHEN oldest IS NOT NULL THEN oldest + to_seconds(CAST(win AS BIGINT)) END AS reset_at
FROM (SELECT client, endpoint, lim, win,
             count(*) FILTER (WHERE ts > now - to_seconds(CAST(win AS BIGINT)) AND ts <= now) AS used,
             min(ts) FILTER (WHERE ts > now - to_seconds(CAST(win AS BIGINT)) AND ts <= now) AS oldest
      FROM lim, now GROUP BY client, endpoint, lim, win) g""")
def r07_quota_status(spark, sf_dir):
    return AD.quota_status(_req(spark, sf_dir), "2024-01-30 23:00:00",
                           endpoint_limits=OUR_ENDPOINT_LIMITS)


@job("r09_tumbling_counts", REQ + """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       endpoint, count(*) AS requests FROM requests GROUP BY ALL""")
def r09_tumbling_counts(spark, sf_dir):
    """R9 windowed counts (the same function runs on the stream; batch form here)."""
    return LV.tumbling_counts(_req(spark, sf_dir), "1 hour")


@job("r09_sliding_counts", REQ + """
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, endpoint, count(*) AS requests
FROM (SELECT endpoint, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS w FROM requests, range(4) r(k)) x
GROUP BY ALL""")
def r09_sliding_counts(spark, sf_dir):
    return LV.sliding_counts(_req(spark, sf_dir), "1 hour", "15 minutes")


@job("r09_session_counts", REQ + """
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, client, count(*) AS requests
FROM (SELECT *, sum(opens) OVER (PARTITION BY client ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no
      FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY client ORDER BY ts, event_id) + INTERVAL 30 MINUTE
                           THEN 0 ELSE 1 END AS opens FROM requests) a) b
GROUP BY client, no""")
def r09_session_counts(spark, sf_dir):
    return LV.session_counts(_req(spark, sf_dir), "30 minutes")
