"""Request-admission analysis over a request log, batch and stream.

Counting forms (R1 fixed window, R2 sliding log, R7 quota) are SQL windows
and aggregates. The sliding log is computed per (client, endpoint, time
block) with a halo of the previous ``window`` seconds copied into each block,
so a client with a third of all requests is still spread over many tasks and
the counts stay exact.

Admission forms where refused requests do not count (R3) and the token
bucket (R4) are sequential per key. Batch: rows are hash-partitioned by key
and sorted, and ``mapInPandas`` walks each partition in Arrow batches while
carrying per-key state (memory = state, never a whole key group). Stream:
``applyInPandasWithState`` with event-time timeout (R8 idle expiry).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed values (must equal the reference's for equal results).
ENDPOINT_LIMITS = {  # endpoint -> (requests, seconds)
    "/api/v1/auth/login": (5, 300),
    "/api/v1/auth/register": (3, 300),
    "/api/v1/players/search": (100, 60),
    "/api/v1/players/bulk": (5, 300),
    "/api/v1/predict": (20, 60),
}
TIER_LIMITS = {"free": (100, 3600), "premium": (1000, 3600), "enterprise": (10000, 3600)}
DEFAULT_LIMIT = (60, 60)
IDLE_SECONDS = 300


# ---------------------------------------------------------------- R6
def client_key(user_id: str | Column, forwarded: str | Column, host: str | Column) -> Column:
    """``user:<id>``, else ``ip:<first forwarded address>``, else ``ip:<host>``, else unknown."""
    u = F.col(user_id) if isinstance(user_id, str) else user_id
    f = F.col(forwarded) if isinstance(forwarded, str) else forwarded
    h = F.col(host) if isinstance(host, str) else host
    first = F.trim(F.split(f, ",")[0])
    return (F.when(u.isNotNull(), F.concat(F.lit("user:"), u.cast("string")))
            .when(f.isNotNull() & (first != ""), F.concat(F.lit("ip:"), first))
            .when(h.isNotNull(), F.concat(F.lit("ip:"), h))
            .otherwise(F.lit("unknown")))


# ---------------------------------------------------------------- R5
def limit_tables(spark, endpoint_limits=ENDPOINT_LIMITS, tier_limits=TIER_LIMITS):
    e = spark.createDataFrame([(k, v[0], v[1]) for k, v in endpoint_limits.items()],
                              "endpoint string, endpoint_limit int, endpoint_window int")
    t = spark.createDataFrame([(k, v[0], v[1]) for k, v in tier_limits.items()],
                              "tier string, tier_limit int, tier_window int")
    return e, t


def resolve_limits(requests: DataFrame, endpoint_limits=ENDPOINT_LIMITS,
                   tier_limits=TIER_LIMITS, default=DEFAULT_LIMIT) -> DataFrame:
    """Endpoint limit, else tier limit, else the default (two broadcast lookups;
    the limit tables are literals of fixed size)."""
    e, t = limit_tables(requests.sparkSession, endpoint_limits, tier_limits)
    out = (requests.join(F.broadcast(e), "endpoint", "left")
           .join(F.broadcast(t), "tier", "left"))
    return out.withColumns({
        "limit": F.coalesce("endpoint_limit", "tier_limit", F.lit(default[0])),
        "window_seconds": F.coalesce("endpoint_window", "tier_window", F.lit(default[1])),
    }).drop("endpoint_limit", "endpoint_window", "tier_limit", "tier_window")


# ---------------------------------------------------------------- R1
def fixed_window_counts(requests: DataFrame, window_seconds: int,
                        keys: Sequence[str] = ("client", "endpoint")) -> DataFrame:
    """R1 aggregate form: requests per key and fixed window."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / window_seconds) * window_seconds)
    return requests.groupBy(*keys, start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("requests"))


def fixed_window_decisions(requests: DataFrame, limit: int, window_seconds: int,
                           keys: Sequence[str] = ("client", "endpoint"),
                           order: Sequence[str] = ("ts", "event_id"), parts: int = 32) -> DataFrame:
    """R1 per request: refused when it is beyond ``limit`` in its fixed window.

    A window is cut into ``parts`` equal stretches of time that are counted (map-side) and
    numbered on their own, so a client's busy window is not one task.
    """
    from pyspark.sql import Window

    start = F.floor(F.unix_timestamp("ts") / window_seconds) * window_seconds
    inside = (F.unix_micros(F.col("ts")) - start * 1_000_000) * parts
    x = requests.withColumn("window_start", F.timestamp_seconds(start)).withColumn(
        "_part", F.floor(inside / (window_seconds * 1_000_000)).cast("int"))
    names = [*keys, "window_start"]
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (x.groupBy(*names, "_part").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    own = Window.partitionBy(*names, "_part").orderBy(*order)
    numbered = x.withColumn("_rn", F.row_number().over(own))
    right = earlier.select(*[F.col(c).alias(f"_k_{c}") for c in (*names, "_part")], "_before")
    cond = None
    for c in (*names, "_part"):
        same = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        cond = same if cond is None else cond & same
    joined = numbered.join(right, cond)
    return joined.select(*requests.columns, "window_start", (F.col("_before") + F.col("_rn")).cast("int").alias("position")).withColumn(
        "refused", F.col("position") > limit)


# ---------------------------------------------------------------- R2
def sliding_log_counts(requests: DataFrame, window_seconds: int,
                       keys: Sequence[str] = ("client", "endpoint"),
                       block_windows: int = 64) -> DataFrame:
    """R2: for each request, requests of its key in (t - w, t] (refused ones included).

    Time is cut into blocks of ``block_windows`` windows; each request also
    goes, as a halo row, to the next block when it lies in the last window of
    its block. The range window then runs per (key, block).
    """
    from pyspark.sql import Window

    w_us = window_seconds * 1_000_000
    block_us = w_us * block_windows
    t = F.unix_micros(F.col("ts"))
    x = requests.withColumn("_t", t).withColumn("_b", F.floor(F.col("_t") / block_us))
    halo_needed = F.col("_t") >= (F.col("_b") + 1) * block_us - w_us
    x = x.withColumn("_copies", F.when(halo_needed, F.array(F.lit(0), F.lit(1)))
                     .otherwise(F.array(F.lit(0))))
    x = x.select("*", F.explode("_copies").alias("_halo")).withColumn(
        "_block", F.col("_b") + F.col("_halo"))
    win = (Window.partitionBy(*keys, "_block").orderBy("_t")
           .rangeBetween(-(w_us - 1), 0))
    counted = x.withColumn("in_window", F.count(F.lit(1)).over(win))
    return counted.where(F.col("_halo") == 0).drop("_t", "_b", "_copies", "_halo", "_block")


def sliding_log_decisions(requests: DataFrame, limit: int, window_seconds: int,
                          keys: Sequence[str] = ("client", "endpoint")) -> DataFrame:
    return sliding_log_counts(requests, window_seconds, keys).withColumn(
        "refused", F.col("in_window") > limit)


# ---------------------------------------------------------------- R7
def quota_status(requests: DataFrame, now: str, keys: Sequence[str] = ("client", "endpoint"),
                 **limits) -> DataFrame:
    """Per key, limit, used in the window ending at ``now``, remaining and reset time."""
    r = resolve_limits(requests, **limits)
    now_ts = F.to_timestamp(F.lit(now))
    in_window = ((F.col("ts") > now_ts - F.make_dt_interval(secs=F.col("window_seconds")))
                 & (F.col("ts") <= now_ts))
    agg = r.groupBy(*keys, "limit", "window_seconds").agg(
        F.count_if(in_window).alias("used"),
        F.min(F.when(in_window, F.col("ts"))).alias("oldest"))
    return agg.select(*keys, "limit", "used",
                      F.greatest(F.lit(0), F.col("limit") - F.col("used")).alias("remaining"),
                      F.when(F.col("oldest").isNotNull(),
                             F.col("oldest") + F.make_dt_interval(secs=F.col("window_seconds")))
                      .alias("reset_at"))


# ---------------------------------------------------------------- R3, R4 (batch)
DECISION_SCHEMA = ("event_id long, key string, ts timestamp, admitted boolean, "
                   "retry_after double")


def _sliding_admission_walk(limit: int, window_seconds: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, list[float]] = {}
        for pdf in batches:
            out_adm, out_retry = [], []
            for key, t in zip(pdf["key"].tolist(), pdf["_t"].tolist()):
                times = [x for x in state.get(key, []) if x > t - window_seconds]
                if len(times) < limit:
                    times.append(t)
                    out_adm.append(True)
                    out_retry.append(None)
                else:
                    out_adm.append(False)
                    out_retry.append(float(int(times[0] + window_seconds - t) + 1))
                state[key] = times
            yield pd.DataFrame({"event_id": pdf["event_id"], "key": pdf["key"], "ts": pdf["ts"],
                                "admitted": out_adm, "retry_after": out_retry})
    return run


def _token_bucket_walk(capacity: float, rate: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, tuple[float, float]] = {}
        for pdf in batches:
            out_adm, out_retry = [], []
            for key, t in zip(pdf["key"].tolist(), pdf["_t"].tolist()):
                tokens, last = state.get(key, (capacity, t))
                tokens = min(capacity, tokens + (t - last) * rate)
                if tokens >= 1:
                    tokens -= 1
                    out_adm.append(True)
                    out_retry.append(None)
                else:
                    out_adm.append(False)
                    out_retry.append((1 - tokens) / rate)
                state[key] = (tokens, t)
            yield pd.DataFrame({"event_id": pdf["event_id"], "key": pdf["key"], "ts": pdf["ts"],
                                "admitted": out_adm, "retry_after": out_retry})
    return run


def _sequential(requests: DataFrame, key_col: str, walker, partitions: int | None) -> DataFrame:
    src = requests.select(F.col("event_id").cast("long"), F.col(key_col).alias("key"), "ts",
                          (F.unix_micros("ts") / 1e6).alias("_t"))
    n = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = src.repartition(n, "key").sortWithinPartitions("key", "_t", "event_id")
    return ordered.mapInPandas(walker, DECISION_SCHEMA)


def sliding_admission(requests: DataFrame, limit: int, window_seconds: float,
                      key_col: str = "client", partitions: int | None = None) -> DataFrame:
    """Admit if admitted requests in (t - w, t] < limit; else retry_after =
    int(oldest + w - t) + 1. Refused requests do not count."""
    return _sequential(requests, key_col, _sliding_admission_walk(limit, window_seconds),
                       partitions)


def token_bucket(requests: DataFrame, capacity: float, rate: float, key_col: str = "client",
                 partitions: int | None = None) -> DataFrame:
    """tokens = min(cap, tokens + dt x rate); admit if >= 1; retry = need / rate."""
    return _sequential(requests, key_col, _token_bucket_walk(capacity, rate), partitions)


# ---------------------------------------------------------------- R3, R8 (stream)
def sliding_admission_stream(requests: DataFrame, limit: int, window_seconds: float,
                             key_col: str = "client", watermark: str = "10 minutes",
                             idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """R3 on a stream, in event time: a request waits in the key's state until the watermark
    has passed it, so requests are decided in the order of the batch form however they
    arrive. State per key: admitted times in the window and waiting requests. R8: a key
    without waiting requests is dropped once its window and ``idle_seconds`` have passed."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, pdfs, state):
        times, wait = ([list(x) for x in (state.get[0], zip(state.get[1], state.get[2], strict=True))]
                       if state.exists else ([], []))
        if not state.hasTimedOut:
            for pdf in pdfs:  # a group may come in several Arrow batches
                wait += zip(pdf["ts"].astype("datetime64[us]").astype("int64").tolist(), pdf["event_id"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000
        wait.sort()
        rows = []
        while wait and wait[0][0] < passed:
            micros, eid = wait.pop(0)
            t, ts = micros / 1e6, pd.Timestamp(micros, unit="us")
            times = [x for x in times if x > t - window_seconds]
            if len(times) < limit:
                times.append(t)
                rows.append((eid, key[0], ts, True, None))
            else:
                rows.append((eid, key[0], ts, False, float(int(times[0] + window_seconds - t) + 1)))
        until = wait[0][0] // 1000 if wait else int((max(times, default=0) + max(window_seconds, idle_seconds)) * 1000)
        if not wait and until * 1000 < passed:
            state.remove()
        else:
            state.update((times, [w[0] for w in wait], [w[1] for w in wait]))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["event_id", "key", "ts", "admitted", "retry_after"])

    kind = dict(requests.dtypes)["event_id"]
    src = requests.select("event_id", F.col(key_col).alias("key"), "ts").withWatermark("ts", watermark)
    return src.groupBy("key").applyInPandasWithState(
        step, DECISION_SCHEMA, f"times array<double>, waiting array<long>, ids array<{kind}>", "append",
        GroupStateTimeout.EventTimeTimeout)
