"""Q1-Q25: filter, sort, top-k and summary queries over the canonical tables.

All functions take DataFrames and column names and return DataFrames; none
collects. Ordered results always end with key columns so ties are stable.
Top-k forms (``orderBy().limit()``) plan as TakeOrderedAndProject: each task
keeps k rows, the driver merges (number of tasks x k) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairplay.functions.numeric import fixed, safe_div, step_band
from fairplay.plans.joins import bounded_broadcast

SEASON_COLUMNS = ["player_name", "team", "league", "season", "position", "appearances",
                  "fouls", "fouls_drawn", "yellow_cards", "red_cards", "minutes"]
SEASON_KEY = ["player_name", "team", "season", "league"]


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row.

    The aggregate runs once as a scalar subquery and its value is inlined in
    the projection: no join, no cartesian product, no single-partition window.
    """
    cols = one_row.columns
    packed = one_row.select(F.struct(*cols).alias("_s")).scalar()
    tmp = "_scalar_struct"
    return df.withColumn(tmp, packed).withColumns(
        {c: F.col(f"{tmp}.{c}") for c in cols}).drop(tmp)


# ---------------------------------------------------------------- Q1, Q2, Q4, Q6
def list_players(df: DataFrame, league: str | None = None, season: str | None = None,
                 team: str | None = None, min_fouls: float | None = None,
                 order: str = "fouls_desc", limit: int = 50, offset: int = 0,
                 columns: Sequence[str] = SEASON_COLUMNS) -> DataFrame:
    """Q1: optional equality filters, ``fouls >= min_fouls``, ordered page."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be in 1..500")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    out = df
    if league:
        out = out.where(F.col("league") == league)
    if season:
        out = out.where(F.col("season") == season)
    if team:
        out = out.where(F.col("team") == team)
    if min_fouls is not None:
        out = out.where(F.col("fouls") >= F.lit(min_fouls))
    keys = [F.col(c).asc() for c in SEASON_KEY]
    if order == "fouls_asc":
        ordering = [F.col("fouls").asc()] + keys
    elif order == "name":
        ordering = keys
    else:
        ordering = [F.col("fouls").desc()] + keys
    out = out.select(*columns).orderBy(*ordering)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def top_fouls(df: DataFrame, league: str, season: str, k: int = 10) -> DataFrame:
    """Q2: top-k players by fouls in one league-season."""
    if not 1 <= k <= 50:
        raise ValueError("k must be in 1..50")
    return (df.where((F.col("league") == league) & (F.col("season") == season))
            .select("player_name", "team", F.col("fouls").cast("double").alias("fouls"))
            .orderBy(F.col("fouls").desc(), "player_name", "team")
            .limit(k))


def search(df: DataFrame, name: str | None = None, team: str | None = None,
           league: str | None = None, season: str | None = None,
           position: str | None = None, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """Q4: text and range search (None = no condition)."""
    conds: list[Column] = []
    if name:
        conds.append(F.lower("player_name").contains(name.lower()))
    if team:
        conds.append(F.lower("team").contains(team.lower()))
    if league:
        conds.append(F.col("league") == league)
    if season:
        conds.append(F.col("season") == season)
    if position:
        conds.append(F.col("position") == position)
    for c, (lo, hi) in (ranges or {}).items():
        if lo is not None and hi is not None and lo > hi:
            raise ValueError(f"min > max for {c}")
        if lo is not None:
            conds.append(F.col(c) >= F.lit(lo))
        if hi is not None:
            conds.append(F.col(c) <= F.lit(hi))
    out = df
    for c in conds:
        out = out.where(c)
    return out


def paginate(df: DataFrame, order_cols: Sequence[str | Column], page: int = 1,
             limit: int = 10) -> DataFrame:
    """Q5: one page of rows plus ``total`` and ``total_pages`` columns."""
    if page < 1 or limit < 1:
        raise ValueError("page and limit must be >= 1")
    total = df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(limit)).cast("long").alias("total_pages"))
    rows = df.orderBy(*order_cols).offset((page - 1) * limit).limit(limit)
    return attach_scalar(rows, total).withColumn("page", F.lit(page))


def search_name(df: DataFrame, q: str, team: str | None = None) -> DataFrame:
    """Q6: case-insensitive substring match on the player name."""
    out = df.where(F.lower("player_name").contains(q.lower()))
    if team:
        out = out.where(F.col("team") == team)
    return out


# ---------------------------------------------------------------- Q3, Q7
def team_fouls_summary(df: DataFrame, league: str | None = None,
                       season: str | None = None) -> DataFrame:
    """Q3: per-team totals (null sums -> 0), ordered by total fouls."""
    out = df
    if league:
        out = out.where(F.col("league") == league)
    if season:
        out = out.where(F.col("season") == season)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(f"total_{c}")

    return (out.groupBy("team")
            .agg(total("fouls"), total("fouls_drawn"), total("yellow_cards"),
                 total("red_cards"), F.count("player_name").alias("player_count"))
            .orderBy(F.col("total_fouls").desc(), "team"))


def record_ratios(df: DataFrame) -> DataFrame:
    """Q7: fouls/cards per game (2 decimals), minutes per foul (1 decimal); 0 on zero."""
    app, fouls = F.col("appearances"), F.col("fouls")
    return df.withColumns({
        "fouls_per_game": F.when(app == 0, 0.0).otherwise(fixed(fouls / app, 2)),
        "cards_per_game": F.when(app == 0, 0.0).otherwise(
            fixed((F.col("yellow_cards") + F.col("red_cards")) / app, 2)),
        "minutes_per_foul": F.when(fouls == 0, 0.0).otherwise(
            fixed(F.col("minutes") / fouls, 1)),
    })


# ---------------------------------------------------------------- Q8-Q13
def dashboard_totals(season_df: DataFrame, predictions: DataFrame | None = None,
                     exact: bool = True) -> DataFrame:
    """Q8: distinct players/teams and card/foul totals (+ prediction count)."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    totals = season_df.agg(
        distinct("player_name").alias("total_players"),
        distinct("team").alias("total_teams"),
        F.coalesce(F.sum("fouls"), F.lit(0)).cast("long").alias("total_fouls"),
        F.coalesce(F.sum("yellow_cards"), F.lit(0)).cast("long").alias("total_yellow_cards"),
        F.coalesce(F.sum("red_cards"), F.lit(0)).cast("long").alias("total_red_cards"),
    )
    if predictions is None:
        return totals.withColumn("total_predictions", F.lit(0).cast("long"))
    n_pred = predictions.agg(F.count(F.lit(1)).alias("total_predictions"))
    return attach_scalar(totals, n_pred)


def monthly(df: DataFrame, value: str | Column, date_col: str = "match_date",
            name: str = "value") -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return (df.groupBy(F.trunc(F.col(date_col), "month").alias("month"))
            .agg(F.sum(v).alias(name)))


def trend_pct(df: DataFrame, metric: str = "fouls", date_col: str = "match_date") -> DataFrame:
    """Q9: month total and signed % change versus the previous month.

    The window runs over the monthly aggregate (a few hundred rows), not over
    the fact rows.
    """
    m = monthly(df, metric, date_col)
    w = Window.orderBy("month")
    prev = F.lag("value").over(w)
    return m.select("month", F.col("value").cast("long").alias("value"),
                    prev.cast("long").alias("prev_value"),
                    (safe_div(F.col("value") - prev, prev, None) * 100.0).alias("change_pct"))


def fouls_by_month(df: DataFrame, metric: str = "fouls", date_col: str = "match_date") -> DataFrame:
    """Q10: (name = 'YYYY-MM', value) series."""
    m = monthly(df, metric, date_col)
    return m.select(F.date_format("month", "yyyy-MM").alias("name"),
                    F.col("value").cast("long").alias("value"))


def cards_by_league(df: DataFrame) -> DataFrame:
    """Q11: (league, yellow + red)."""
    return df.groupBy("league").agg(
        F.sum(F.col("yellow_cards") + F.col("red_cards")).cast("long").alias("cards"))


def top_players(pm: DataFrame, k: int = 5) -> DataFrame:
    """Q12: top-k players by fouls with rank and fouls per match (1 decimal)."""
    per_player = pm.groupBy("player_id", "player_name").agg(
        F.sum("fouls").cast("long").alias("fouls"),
        F.sum(F.col("yellow_cards") + F.col("red_cards")).cast("long").alias("cards"),
        F.count(F.lit(1)).alias("matches"))
    top = per_player.orderBy(F.col("fouls").desc(), "player_id").limit(k)
    # The ranking window runs over k rows only.
    w = Window.orderBy(F.col("fouls").desc(), "player_id")
    return top.select(
        F.row_number().over(w).alias("rank"), "player_id", "player_name", "fouls", "cards",
        "matches",
        F.when(F.col("matches") == 0, 0.0).otherwise(
            fixed(F.col("fouls") / F.col("matches"), 1)).alias("fouls_per_match"))


def match_status(today: Column, date_col: str = "match_date") -> Column:
    """Status of a match on the day ``today``."""
    d = F.to_date(date_col)
    return F.when(d > today, "scheduled").when(d == today, "live").otherwise("finished")


def matches(pm: DataFrame, today=None, team_names: DataFrame | None = None) -> DataFrame:
    """Match table (one row per match) with status relative to ``today``.

    ``today`` is a parameter (a date literal); default = the latest match date.
    """
    per_match = pm.groupBy("match_id").agg(
        F.max("match_date").alias("match_date"),
        F.max("home_team_id").alias("home_team_id"),
        F.max("away_team_id").alias("away_team_id"),
        F.max("league").alias("league"),
        F.sum(F.when(F.col("team_id") == F.col("home_team_id"), F.col("fouls")).otherwise(0))
        .cast("long").alias("fouls_home"),
        F.sum(F.when(F.col("team_id") == F.col("away_team_id"), F.col("fouls")).otherwise(0))
        .cast("long").alias("fouls_away"),
        F.sum(F.when(F.col("team_id") == F.col("home_team_id"),
                     F.col("yellow_cards") + F.col("red_cards")).otherwise(0))
        .cast("long").alias("cards_home"),
        F.sum(F.when(F.col("team_id") == F.col("away_team_id"),
                     F.col("yellow_cards") + F.col("red_cards")).otherwise(0))
        .cast("long").alias("cards_away"),
    )
    if today is None:
        anchor = pm.agg(F.max(F.to_date("match_date")).alias("_today"))
        per_match = attach_scalar(per_match, anchor)
        today_col = F.col("_today")
    else:
        today_col = F.lit(today).cast("date")
    out = per_match.withColumn("status", match_status(today_col))
    if team_names is not None:
        names = bounded_broadcast(team_names)
        out = (out.join(names.select(F.col("team_id").alias("home_team_id"),
                                     F.col("team").alias("home_team")), "home_team_id", "left")
               .join(names.select(F.col("team_id").alias("away_team_id"),
                                  F.col("team").alias("away_team")), "away_team_id", "left"))
    return out.drop("_today")


def recent_matches(match_df: DataFrame, k: int = 5) -> DataFrame:
    """Q13: latest k matches."""
    return match_df.orderBy(F.col("match_date").desc(), F.col("match_id").desc()).limit(k)


def match_stats(match_df: DataFrame) -> DataFrame:
    """Q14: fouls and cards of the home and away side per match."""
    return match_df.select("match_id", "home_team_id", "away_team_id", "fouls_home",
                           "fouls_away", "cards_home", "cards_away")


def list_matches(match_df: DataFrame, status: str | None = None, team_id: int | None = None,
                 page: int = 1, per_page: int = 10) -> DataFrame:
    """Q15: status and team (home or away) filter, 10 per page."""
    out = match_df
    if status:
        out = out.where(F.col("status") == status)
    if team_id is not None:
        out = out.where((F.col("home_team_id") == team_id) | (F.col("away_team_id") == team_id))
    return paginate(out, [F.col("match_date").desc(), F.col("match_id").desc()], page, per_page)


# ---------------------------------------------------------------- Q16-Q18
def team_season_table(season_df: DataFrame) -> DataFrame:
    return season_df.groupBy("season", "team").agg(
        F.sum("fouls").cast("long").alias("fouls"),
        F.sum("yellow_cards").cast("long").alias("yellow_cards"),
        F.sum("red_cards").cast("long").alias("red_cards"),
        F.sum("appearances").cast("long").alias("appearances"),
        F.count(F.lit(1)).alias("players"))


def rank_teams(season_df: DataFrame) -> DataFrame:
    """Q16: discipline score per (season, team), its position and band.

    score = 10 - 10 * percent_rank(per-appearance weight) within the season,
    weight = (yellow + 2 red + fouls / 10) / max(appearances, 1); 1 decimal.
    The windows run on the team-season aggregate, partitioned by season.
    """
    t = team_season_table(season_df)
    weight = ((F.col("yellow_cards") + 2 * F.col("red_cards") + F.col("fouls") / 10.0)
              / F.greatest(F.col("appearances"), F.lit(1)))
    t = t.withColumn("card_weight", weight)
    pr = F.percent_rank().over(Window.partitionBy("season").orderBy("card_weight"))
    t = t.withColumn("discipline_score", fixed(10.0 - 10.0 * pr, 1))
    pos = F.row_number().over(Window.partitionBy("season").orderBy(
        F.col("discipline_score").desc(), "team"))
    return t.select("season", "team", "fouls", "yellow_cards", "red_cards", "appearances",
                    fixed("card_weight", 6).alias("card_weight"), "discipline_score",
                    pos.alias("position"),
                    discipline_band("discipline_score").alias("band"))


def discipline_band(score: str | Column) -> Column:
    return step_band(score, [(8.0, "good"), (7.0, "fair")], "poor")


def risk_band(score: str | Column) -> Column:
    """Q18: risk score >= 8 high, >= 6 medium, else low."""
    return step_band(score, [(8.0, "high"), (6.0, "medium")], "low")


def probability_band(p: str | Column) -> Column:
    """Q18: probability >= 80 / 60 / 40."""
    return step_band(p, [(80.0, "very_likely"), (60.0, "likely"), (40.0, "possible")], "unlikely")


def team_headlines(season_df: DataFrame) -> DataFrame:
    """Q17: most disciplined team, most fouls per game, overall mean fouls per game."""
    per_team = season_df.groupBy("team").agg(
        F.sum("fouls").alias("fouls"),
        F.sum(F.col("yellow_cards") + 2 * F.col("red_cards")).alias("card_points"),
        F.sum("appearances").alias("appearances"))
    per_team = per_team.withColumns({
        "fouls_per_game": F.col("fouls") / F.greatest(F.col("appearances"), F.lit(1)),
        "points_per_game": F.col("card_points") / F.greatest(F.col("appearances"), F.lit(1)),
    })
    return per_team.agg(
        F.min_by("team", F.struct("points_per_game", "team")).alias("most_disciplined_team"),
        F.max_by("team", F.struct("fouls_per_game", "team")).alias("most_fouls_per_game_team"),
        fixed(F.max("fouls_per_game"), 6).alias("max_fouls_per_game"),
        fixed(F.avg("fouls_per_game"), 6).alias("mean_fouls_per_game"))


# ---------------------------------------------------------------- Q19-Q25
def prediction_summary(pred: DataFrame) -> DataFrame:
    """Q19: totals over all prediction rows."""
    return pred.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("confidence") == "high").alias("high_confidence"),
        F.count_if(F.col("type") == "foul").alias("foul_predictions"),
        F.count_if(F.col("type").contains("card")).alias("card_predictions"))


def list_predictions(pred: DataFrame, type_: str | None = None, confidence: str | None = None,
                     match_id: int | None = None, player: str | None = None) -> DataFrame:
    """Q20: filter predictions."""
    out = pred
    if type_:
        out = out.where(F.col("type") == type_)
    if confidence:
        out = out.where(F.col("confidence") == confidence)
    if match_id is not None:
        out = out.where(F.col("match_id") == match_id)
    if player:
        out = out.where(F.lower("player_name").contains(player.lower()))
    return out


PERIOD_DAYS = {"7d": 7, "30d": 30, "90d": 90, "1y": 365}


def trailing_period(pm: DataFrame, period: str = "30d",
                    metrics: Sequence[str] = ("fouls", "yellow_cards", "red_cards"),
                    date_col: str = "match_date", anchor=None) -> DataFrame:
    """Q21: totals over [anchor - n, anchor] and [anchor - 2n, anchor - n), change %.

    anchor = latest date, or a date literal that the caller knows to be it (then ``pm``
    needs no rows before anchor - 2n). Two conditional aggregates in one pass.
    """
    n = PERIOD_DAYS[period]
    if anchor is None:
        x = attach_scalar(pm.select(date_col, *metrics), pm.agg(F.max(F.to_date(date_col)).alias("_anchor")))
    else:
        x = pm.select(date_col, *metrics, F.lit(anchor).cast("date").alias("_anchor"))
    d = F.to_date(date_col)
    cur = (d >= F.date_sub("_anchor", n)) & (d <= F.col("_anchor"))
    prev = (d >= F.date_sub("_anchor", 2 * n)) & (d < F.date_sub("_anchor", n))
    aggs = []
    for m in metrics:
        aggs += [F.coalesce(F.sum(F.when(cur, F.col(m))), F.lit(0)).cast("long").alias(f"{m}_current"),
                 F.coalesce(F.sum(F.when(prev, F.col(m))), F.lit(0)).cast("long").alias(f"{m}_previous")]
    out = x.groupBy("_anchor").agg(*aggs).withColumnRenamed("_anchor", "anchor_date")
    for m in metrics:
        out = out.withColumn(f"{m}_change_pct", fixed(
            safe_div(F.col(f"{m}_current") - F.col(f"{m}_previous"), F.col(f"{m}_previous"), None)
            * 100.0, 6))
    return out.withColumn("period", F.lit(period))


def chart_series(pm: DataFrame, metric: str = "fouls", date_col: str = "match_date") -> DataFrame:
    """Q22: daily total and value / max(value) * 100 (window over the daily aggregate)."""
    daily = pm.groupBy(F.to_date(date_col).alias("date")).agg(
        F.sum(metric).cast("long").alias("value"))
    mx = daily.agg(F.max("value").alias("_max"))
    return attach_scalar(daily, mx).select(
        "date", "value", fixed(safe_div(F.col("value") * 100.0, "_max"), 6).alias("pct_of_max"))


def team_performance(season_df: DataFrame) -> DataFrame:
    """Q23: per team fouls / max(fouls) * 100."""
    per_team = season_df.groupBy("team").agg(F.sum("fouls").cast("long").alias("fouls"))
    mx = per_team.agg(F.max("fouls").alias("_max"))
    return attach_scalar(per_team, mx).select(
        "team", "fouls", fixed(safe_div(F.col("fouls") * 100.0, "_max"), 6).alias("pct_of_max"))


def min_games(pm: DataFrame, n: int = 5, player_col: str = "player_id") -> DataFrame:
    """Q24: rows of players with at least n rows (aggregate + left semi join)."""
    keep = pm.groupBy(player_col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return pm.join(keep.select(player_col), player_col, "left_semi")


def data_info(pm: DataFrame, exact: bool = True) -> DataFrame:
    """Q25: row count, distinct players and teams, date range."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return pm.agg(
        F.count(F.lit(1)).alias("rows"),
        distinct("player_id").alias("players"),
        distinct("team").alias("teams"),
        F.min("match_date").alias("first_date"),
        F.max("match_date").alias("last_date"))
