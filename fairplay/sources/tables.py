"""Readers for the stored tables and the canonical views built from them.

The driver tables are TPC-H shaped. The canonical sports tables are derived
from them by the rules below (one rule set, shared by the DuckDB oracle text
in ``fairplay.plans.oracle``):

player_match   one row per order: player = customer, team = nation,
               league = region, counters aggregated from the order's lines.
player_season  player_match summed per (player, calendar year of the match).
requests       events as a request log.
runs, run_metrics, model_versions   orders as an experiment store.

Plan shape at scale: lines are aggregated per order *before* any join
(partial aggregation map-side, one shuffle on the order key), the order join
reuses that partitioning, and the nation/region dimension is broadcast only
behind a size check.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairplay.plans.joins import bounded_broadcast, counted_broadcast
from fairplay.plans.windows import ordered_index

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def position_of_segment(segment: Column) -> Column:
    # Fixed mapping of market segment to playing position (fixture rule).
    return (F.when(segment == "HOUSEHOLD", "GK")
            .when(segment == "MACHINERY", "DF")
            .when(segment == "FURNITURE", "MF")
            .when(segment == "BUILDING", "FW")
            .otherwise("DF,MF"))


def _order_counters(spark: SparkSession, sf_dir: str, match_ids: Sequence[int] | None = None,
                    orders: DataFrame | None = None) -> DataFrame:
    """Counters per order; of the given ids or ``orders`` (a checked side) only, where given."""
    li = read_table(spark, sf_dir, "lineitem")
    if match_ids is not None:
        li = li.where(F.col("l_orderkey").isin(list(match_ids)))
    if orders is not None:
        li = li.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return li.groupBy("l_orderkey").agg(
        F.sum("l_linenumber").alias("appearances"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("fouls"),
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("fouls_drawn"),
        F.count_if(F.col("l_returnflag") == "A").alias("yellow_cards"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
        .alias("red_cards"),
        F.sum((F.col("l_quantity") * 15).cast("bigint")).alias("minutes_played"),
    )


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    geo = nation.join(bounded_broadcast(region), nation.n_regionkey == region.r_regionkey)
    return geo.select(F.col("n_nationkey"), F.col("n_name").alias("team"),
                      F.col("r_name").alias("league"))


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    geo = bounded_broadcast(_geography(spark, sf_dir))
    return customer.join(geo, customer.c_nationkey == geo.n_nationkey).select(
        F.col("c_custkey").alias("player_id"),
        F.col("c_name").alias("player_name"),
        F.col("n_nationkey").cast("long").alias("team_id"),
        "team", "league",
        position_of_segment(F.col("c_mktsegment")).alias("position"),
    )


def _orders(spark: SparkSession, sf_dir: str, since: datetime | None = None) -> DataFrame:
    """Orders of that time or later (a predicate of the scan); a few are broadcast by count."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if since is None:
        return orders
    orders = orders.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
    return counted_broadcast(orders, orders.count())


def _sides() -> list[Column]:
    """(home_team_id, away_team_id): the player's team plays home in even matches."""
    other = F.pmod(F.col("team_id") + 1, F.lit(25))
    home = F.pmod(F.col("o_orderkey"), F.lit(2)) == 0
    return [F.when(home, F.col("team_id")).otherwise(other).alias("home_team_id"),
            F.when(home, other).otherwise(F.col("team_id")).alias("away_team_id")]


def match_heads(spark: SparkSession, sf_dir: str, since: datetime | None = None) -> DataFrame:
    """(match_id, match_date, home_team_id, away_team_id) of every match of ``player_match``,
    without its counters: of the lines only the key column is read."""
    orders = _orders(spark, sf_dir, since)
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey")
    if since is not None:  # few orders: sent to the lines, whose keys need no shuffle of all
        lines = lines.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").distinct()
    players = bounded_broadcast(_players(spark, sf_dir).select("player_id", "team_id"))
    heads = orders.join(players, F.col("o_custkey") == F.col("player_id"))
    heads = heads.select(F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("match_date"), *_sides())
    return heads.join(lines, F.col("match_id") == F.col("l_orderkey"), "left_semi")


def since_newest(spark: SparkSession, sf_dir: str, k: int = 1) -> datetime | None:
    """A time from which on there are at least ``k`` matches; None: all must be read.

    Starts at the newest day and widens the span fourfold until it holds k matches, so
    only the newest days are joined. No more than three numbers reach the driver per turn.
    """
    dates = read_table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).first()
    if dates.b is None:
        return None
    span = timedelta(days=1)
    while dates.b - span > dates.a:
        if match_heads(spark, sf_dir, dates.b - span).limit(k).count() >= k:
            return dates.b - span
        span *= 4
    return None


def player_match(spark: SparkSession, sf_dir: str, match_ids: Sequence[int] | None = None,
                 since: datetime | None = None) -> DataFrame:
    """Canonical player x match table (one row per order); of the given matches, or of that
    time and later, only: both reach the scans, and other lines are not aggregated."""
    orders = _orders(spark, sf_dir, since)
    if match_ids is not None:
        orders = orders.where(F.col("o_orderkey").isin(list(match_ids)))
    counters = _order_counters(spark, sf_dir, match_ids, orders if since is not None else None)
    matches = counters.join(orders, counters.l_orderkey == orders.o_orderkey)
    players = bounded_broadcast(_players(spark, sf_dir))
    pm = matches.join(players, matches.o_custkey == players.player_id)
    return pm.select(
        "player_id", "player_name",
        F.col("o_orderkey").alias("match_id"),
        F.col("o_orderdate").alias("match_date"),
        F.year("o_orderdate").alias("season_start_year"),
        "team_id", "team", "league", "position",
        *_sides(),
        "appearances", "fouls", "fouls_drawn", "yellow_cards", "red_cards", "minutes_played",
    )


def player_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical season table: one row per (player, season).

    Aggregates orders per (customer, year) first and joins the player
    attributes afterwards, so the wide string columns never enter the
    aggregation shuffle.
    """
    counters = _order_counters(spark, sf_dir)
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    seasons = (counters.join(orders, counters.l_orderkey == orders.o_orderkey)
               .groupBy(F.col("o_custkey").alias("player_id"),
                        F.year("o_orderdate").alias("season_start_year"))
               .agg(F.sum("appearances").alias("appearances"),
                    F.sum("fouls").alias("fouls"),
                    F.sum("fouls_drawn").alias("fouls_drawn"),
                    F.sum("yellow_cards").alias("yellow_cards"),
                    F.sum("red_cards").alias("red_cards"),
                    F.sum("minutes_played").alias("minutes")))
    players = bounded_broadcast(_players(spark, sf_dir))
    return seasons.join(players, "player_id").select(
        "player_id", "player_name", "team", "league",
        F.concat_ws("-", F.col("season_start_year").cast("string"),
                    (F.col("season_start_year") + 1).cast("string")).alias("season"),
        "season_start_year", "position", "appearances", "fouls", "fouls_drawn",
        "yellow_cards", "red_cards", "minutes",
    )


def requests_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a request log: (event_id, ts, user_id, client, endpoint, tier)."""
    ev = read_table(spark, sf_dir, "events")
    tier = F.element_at(F.array(F.lit("free"), F.lit("premium"), F.lit("enterprise")),
                        (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("int"))
    return ev.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("client"),
        F.col("event_type").alias("endpoint"),
        tier.alias("tier"),
    )


def runs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderstatus") == "F", "FINISHED")
              .when(F.col("o_orderstatus") == "O", "RUNNING")
              .otherwise("FAILED"))
    start = F.col("o_orderdate").cast("timestamp")
    end = start + F.make_dt_interval(secs=F.pmod(F.col("o_orderkey"), F.lit(7200)).cast("int"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.lit("discipline").alias("experiment"),
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("name"),
        status.alias("status"),
        start.alias("start_time"),
        F.when(status == "RUNNING", F.lit(None).cast("timestamp")).otherwise(end).alias("end_time"),
    )


def run_metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    rmse = F.col("o_totalprice") / 100000.0
    return o.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.explode(F.array(
            F.struct(F.lit("val_rmse").alias("key"), rmse.alias("value")),
            F.struct(F.lit("val_mae").alias("key"), (rmse * 0.8).alias("value")),
        )).alias("m")).select("run_id", "m.key", "m.value")


MODELS = ("xgboost", "random_forest", "gradient_boosting")
TARGETS = ("fouls", "yellow_cards", "red_cards")


def model_versions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]),
                         (F.pmod(F.col("o_custkey"), F.lit(3)) + 1).cast("int"))
    target = F.element_at(F.array(*[F.lit(t) for t in TARGETS]),
                          (F.pmod(F.floor(F.col("o_custkey") / 3), F.lit(3)) + 1).cast("int"))
    stage = (F.when(F.col("o_orderpriority").startswith("1"), "Production")
             .when(F.col("o_orderpriority").startswith("2"), "Staging")
             .when(F.col("o_orderpriority").startswith("3"), "Archived")
             .otherwise("None"))
    base = o.select(model.alias("model"), target.alias("target"), stage.alias("stage"),
                    F.col("o_orderkey").cast("string").alias("run_id"),
                    F.col("o_orderdate").cast("timestamp").alias("created"),
                    F.col("o_orderkey"))
    # Version = position by (created, order key) inside (model, target):
    # numbered by ranges so the 9 (model, target) groups do not each become
    # one task.
    numbered = ordered_index(base, ["model", "target"], ["created", "o_orderkey"], name="version")
    return numbered.select("model", "target", F.col("version").cast("int").alias("version"),
                           "stage", "run_id", "created", F.col("created").alias("updated"))
