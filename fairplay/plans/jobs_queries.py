"""Registered jobs for the query operators (Q1-Q25) and the load steps S3, S9."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fairplay.operators import queries as Q
from fairplay.operators.ingest import with_provenance
from fairplay.plans.catalog import job
from fairplay.plans.oracle import fixed_sql, with_views
from fairplay.sources import tables as TB

LEAGUE = "EUROPE"
SEASON = "1997-1998"
LOAD_TS = "2024-01-01 00:00:00"

PS = with_views("player_season")
PM = with_views("player_match")


def _ps(spark, sf_dir):
    return TB.player_season(spark, sf_dir)


def _pm(spark, sf_dir):
    return TB.player_match(spark, sf_dir)


def _team_names(spark, sf_dir):
    return TB.read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("team"))


def _matches(spark, sf_dir):
    return Q.matches(_pm(spark, sf_dir), team_names=_team_names(spark, sf_dir))


def _today(spark, sf_dir):
    """The date of the latest match, from the newest orders (None: there is none)."""
    heads = TB.match_heads(spark, sf_dir, TB.since_newest(spark, sf_dir))
    return heads.agg(F.max(F.to_date("match_date"))).first()[0]


SEASON_COLS = ", ".join(Q.SEASON_COLUMNS)

MATCHES_SQL = """
  SELECT m.*, h.n_name AS home_team, a.n_name AS away_team,
         CASE WHEN CAST(m.match_date AS DATE) > t.today THEN 'scheduled'
              WHEN CAST(m.match_date AS DATE) = t.today THEN 'live' ELSE 'finished' END AS status
  FROM (SELECT match_id, max(match_date) AS match_date, max(home_team_id) AS home_team_id,
               max(away_team_id) AS away_team_id, max(league) AS league,
               CAST(sum(CASE WHEN team_id = home_team_id THEN fouls ELSE 0 END) AS BIGINT) AS fouls_home,
               CAST(sum(CASE WHEN team_id = away_team_id THEN fouls ELSE 0 END) AS BIGINT) AS fouls_away,
               CAST(sum(CASE WHEN team_id = home_team_id THEN yellow_cards + red_cards ELSE 0 END) AS BIGINT) AS cards_home,
               CAST(sum(CASE WHEN team_id = away_team_id THEN yellow_cards + red_cards ELSE 0 END) AS BIGINT) AS cards_away
        FROM player_match GROUP BY match_id) m
  CROSS JOIN (SELECT max(CAST(match_date AS DATE)) AS today FROM player_match) t
  LEFT JOIN nation h ON CAST(h.n_nationkey AS BIGINT) = m.home_team_id
  LEFT JOIN nation a ON CAST(a.n_nationkey AS BIGINT) = m.away_team_id"""

MATCHES = with_views("player_match", extra={"matches": MATCHES_SQL})


@job("s3_load_player_matches", PM + "SELECT * FROM player_match WHERE minutes_played > 0")
def s3_load_player_matches(spark, sf_dir):
    """S3: the 4-way fact/dimension join, minutes > 0."""
    return _pm(spark, sf_dir).where(F.col("minutes_played") > 0)


@job("s9_with_provenance", PM + f"""
SELECT *, 'orders' AS source, TIMESTAMP '{LOAD_TS}' AS loaded_at FROM player_match""")
def s9_with_provenance(spark, sf_dir):
    """Append source and load time."""
    return with_provenance(_pm(spark, sf_dir), source="orders", loaded_at=LOAD_TS)


@job("q1_list_players", PS + f"""
SELECT {SEASON_COLS} FROM player_season
WHERE league = '{LEAGUE}' AND season = '{SEASON}' AND fouls >= 30
ORDER BY fouls DESC, player_name, team, season, league LIMIT 500""")
def q1_list_players(spark, sf_dir):
    return Q.list_players(_ps(spark, sf_dir), league=LEAGUE, season=SEASON, min_fouls=30,
                          order="fouls_desc", limit=500)


@job("q1_list_players_by_name_page", PS + f"""
SELECT {SEASON_COLS} FROM player_season WHERE team = 'NATION_7'
ORDER BY player_name, team, season, league LIMIT 50 OFFSET 20""")
def q1_list_players_by_name_page(spark, sf_dir):
    return Q.list_players(_ps(spark, sf_dir), team="NATION_7", order="name", limit=50, offset=20)


@job("q2_top_fouls", PS + f"""
SELECT player_name, team, CAST(fouls AS DOUBLE) AS fouls FROM player_season
WHERE league = '{LEAGUE}' AND season = '{SEASON}'
ORDER BY fouls DESC, player_name, team LIMIT 50""", doubles=["fouls"])
def q2_top_fouls(spark, sf_dir):
    return Q.top_fouls(_ps(spark, sf_dir), LEAGUE, SEASON, k=50)


_Q3_SELECT = """
SELECT team,
       coalesce(CAST(sum(fouls) AS DOUBLE), 0.0) AS total_fouls,
       coalesce(CAST(sum(fouls_drawn) AS DOUBLE), 0.0) AS total_fouls_drawn,
       coalesce(CAST(sum(yellow_cards) AS DOUBLE), 0.0) AS total_yellow_cards,
       coalesce(CAST(sum(red_cards) AS DOUBLE), 0.0) AS total_red_cards,
       count(player_name) AS player_count
FROM player_season {where} GROUP BY team ORDER BY total_fouls DESC, team"""
_Q3_DOUBLES = ["total_fouls", "total_fouls_drawn", "total_yellow_cards", "total_red_cards"]


@job("q3_team_fouls_summary",
     PS + _Q3_SELECT.format(where=f"WHERE league = '{LEAGUE}' AND season = '{SEASON}'"),
     doubles=_Q3_DOUBLES)
def q3_team_fouls_summary(spark, sf_dir):
    return Q.team_fouls_summary(_ps(spark, sf_dir), LEAGUE, SEASON)


@job("q3_team_fouls_summary_all", PS + _Q3_SELECT.format(where=""), doubles=_Q3_DOUBLES)
def q3_team_fouls_summary_all(spark, sf_dir):
    return Q.team_fouls_summary(_ps(spark, sf_dir))


@job("q4_search", PS + f"""
SELECT * FROM player_season
WHERE contains(lower(player_name), '00001') AND league = '{LEAGUE}'
  AND fouls >= 20 AND fouls <= 60 AND appearances <= 80""")
def q4_search(spark, sf_dir):
    return Q.search(_ps(spark, sf_dir), name="00001", league=LEAGUE,
                    ranges={"fouls": (20, 60), "appearances": (None, 80)})


@job("q5_paginate", PS + f"""
SELECT p.*, t.total, t.total_pages, 3 AS page
FROM (SELECT {SEASON_COLS} FROM player_season
      ORDER BY fouls DESC, player_name, team, season, league LIMIT 25 OFFSET 50) p,
     (SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages FROM player_season) t""")
def q5_paginate(spark, sf_dir):
    ps = _ps(spark, sf_dir).select(*Q.SEASON_COLUMNS)
    order = [F.col("fouls").desc()] + [F.col(c) for c in Q.SEASON_KEY]
    return Q.paginate(ps, order, page=3, limit=25)


@job("q6_search_name", PS + """
SELECT * FROM player_season WHERE contains(lower(player_name), lower('Customer#0000012'))""")
def q6_search_name(spark, sf_dir):
    return Q.search_name(_ps(spark, sf_dir), "Customer#0000012")


@job("q7_record_ratios", PS + f"""
SELECT *,
  CASE WHEN appearances = 0 THEN 0.0 ELSE {fixed_sql('fouls / appearances', 2)} END AS fouls_per_game,
  CASE WHEN appearances = 0 THEN 0.0 ELSE {fixed_sql('(yellow_cards + red_cards) / appearances', 2)} END AS cards_per_game,
  CASE WHEN fouls = 0 THEN 0.0 ELSE {fixed_sql('minutes / fouls', 1)} END AS minutes_per_foul
FROM player_season""", doubles=["fouls_per_game", "cards_per_game", "minutes_per_foul"])
def q7_record_ratios(spark, sf_dir):
    return Q.record_ratios(_ps(spark, sf_dir))


@job("q8_dashboard_totals", PS + """
SELECT count(DISTINCT player_name) AS total_players, count(DISTINCT team) AS total_teams,
       CAST(coalesce(sum(fouls), 0) AS BIGINT) AS total_fouls,
       CAST(coalesce(sum(yellow_cards), 0) AS BIGINT) AS total_yellow_cards,
       CAST(coalesce(sum(red_cards), 0) AS BIGINT) AS total_red_cards,
       (SELECT count(*) FROM orders) AS total_predictions
FROM player_season""")
def q8_dashboard_totals(spark, sf_dir):
    # One prediction per match (see fairplay.operators.predict.standin_predictions).
    preds = TB.read_table(spark, sf_dir, "orders").select("o_orderkey")
    return Q.dashboard_totals(_ps(spark, sf_dir), predictions=preds)


_MONTHLY = "SELECT CAST(date_trunc('month', match_date) AS DATE) AS month, sum(fouls) AS value FROM player_match GROUP BY 1"


@job("q9_trend_pct", PM + f"""
SELECT month, CAST(value AS BIGINT) AS value, CAST(prev AS BIGINT) AS prev_value,
       (value - prev) / CAST(nullif(prev, 0) AS DOUBLE) * 100.0 AS change_pct
FROM (SELECT month, value, lag(value) OVER (ORDER BY month) AS prev FROM ({_MONTHLY}) m) x""",
     doubles=["change_pct"])
def q9_trend_pct(spark, sf_dir):
    return Q.trend_pct(_pm(spark, sf_dir), "fouls")


@job("q10_fouls_by_month", PM + f"""
SELECT strftime(month, '%Y-%m') AS name, CAST(value AS BIGINT) AS value FROM ({_MONTHLY}) m""")
def q10_fouls_by_month(spark, sf_dir):
    return Q.fouls_by_month(_pm(spark, sf_dir))


@job("q11_cards_by_league", PS + """
SELECT league, CAST(sum(yellow_cards + red_cards) AS BIGINT) AS cards FROM player_season GROUP BY league""")
def q11_cards_by_league(spark, sf_dir):
    return Q.cards_by_league(_ps(spark, sf_dir))


@job("q12_top_players", PM + f"""
SELECT CAST(row_number() OVER (ORDER BY fouls DESC, player_id) AS INTEGER) AS rank, player_id, player_name, fouls, cards,
       matches,
       CASE WHEN matches = 0 THEN 0.0 ELSE {fixed_sql('fouls / matches', 1)} END AS fouls_per_match
FROM (SELECT player_id, player_name, CAST(sum(fouls) AS BIGINT) AS fouls,
             CAST(sum(yellow_cards + red_cards) AS BIGINT) AS cards, count(*) AS matches
      FROM player_match GROUP BY player_id, player_name
      ORDER BY fouls DESC, player_id LIMIT 5) t""", doubles=["fouls_per_match"])
def q12_top_players(spark, sf_dir):
    return Q.top_players(_pm(spark, sf_dir), 5)


@job("q13_recent_matches", MATCHES + """
SELECT * FROM matches ORDER BY match_date DESC, match_id DESC LIMIT 5""")
def q13_recent_matches(spark, sf_dir):
    """The newest matches are chosen by their dates; lines are read and added up for these alone."""
    k = 5
    heads = TB.match_heads(spark, sf_dir, TB.since_newest(spark, sf_dir, k))
    newest = heads.orderBy(F.col("match_date").desc(), F.col("match_id").desc()).limit(k).collect()  # k rows
    today = newest[0].match_date.date() if newest else None
    pm = TB.player_match(spark, sf_dir, match_ids=[r.match_id for r in newest])
    return Q.recent_matches(Q.matches(pm, today, _team_names(spark, sf_dir)), k)


@job("q14_match_stats", MATCHES + """
SELECT match_id, home_team_id, away_team_id, fouls_home, fouls_away, cards_home, cards_away FROM matches""")
def q14_match_stats(spark, sf_dir):
    return Q.match_stats(_matches(spark, sf_dir))


@job("q15_list_matches", MATCHES + """
SELECT p.*, t.total, t.total_pages, 2 AS page
FROM (SELECT * FROM matches WHERE status = 'finished' AND (home_team_id = 3 OR away_team_id = 3)
      ORDER BY match_date DESC, match_id DESC LIMIT 10 OFFSET 10) p,
     (SELECT count(*) AS total, CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages FROM matches
      WHERE status = 'finished' AND (home_team_id = 3 OR away_team_id = 3)) t""")
def q15_list_matches(spark, sf_dir):
    """The page and its totals come from the matches' heads; lines are added up for the page alone."""
    today = _today(spark, sf_dir)
    heads = TB.match_heads(spark, sf_dir).withColumn("status", Q.match_status(F.lit(today).cast("date")))
    page = Q.list_matches(heads, status="finished", team_id=3, page=2).select("match_id", "total", "total_pages", "page")
    rows = page.collect()  # at most the ten rows of the page
    pm = TB.player_match(spark, sf_dir, match_ids=[r.match_id for r in rows])
    totals = F.broadcast(spark.createDataFrame(rows, page.schema))
    return Q.matches(pm, today, _team_names(spark, sf_dir)).join(totals, "match_id")


_TEAM_SEASON = """
  SELECT season, team, CAST(sum(fouls) AS BIGINT) AS fouls, CAST(sum(yellow_cards) AS BIGINT) AS yellow_cards,
         CAST(sum(red_cards) AS BIGINT) AS red_cards, CAST(sum(appearances) AS BIGINT) AS appearances,
         count(*) AS players
  FROM player_season GROUP BY season, team"""


@job("q16_rank_teams", with_views("player_season", extra={"ts": _TEAM_SEASON}) + f"""
SELECT season, team, fouls, yellow_cards, red_cards, appearances, {fixed_sql('card_weight', 6)} AS card_weight,
       discipline_score,
       CAST(row_number() OVER (PARTITION BY season ORDER BY discipline_score DESC, team) AS INTEGER) AS position,
       CASE WHEN discipline_score >= 8.0 THEN 'good' WHEN discipline_score >= 7.0 THEN 'fair' ELSE 'poor' END AS band
FROM (SELECT *, {fixed_sql('10.0 - 10.0 * percent_rank() OVER (PARTITION BY season ORDER BY card_weight)', 1)} AS discipline_score
      FROM (SELECT *, (yellow_cards + 2 * red_cards + fouls / 10.0) / greatest(appearances, 1) AS card_weight FROM ts) a) b""",
     doubles=["card_weight", "discipline_score"])
def q16_rank_teams(spark, sf_dir):
    return Q.rank_teams(_ps(spark, sf_dir))


@job("q17_team_headlines", with_views("player_season", extra={"pt": """
  SELECT team, sum(fouls) AS fouls, sum(yellow_cards + 2 * red_cards) AS card_points, sum(appearances) AS appearances,
         sum(fouls) / greatest(sum(appearances), 1) AS fouls_per_game,
         sum(yellow_cards + 2 * red_cards) / greatest(sum(appearances), 1) AS points_per_game
  FROM player_season GROUP BY team"""}) + f"""
SELECT (SELECT team FROM pt ORDER BY points_per_game, team LIMIT 1) AS most_disciplined_team,
       (SELECT team FROM pt ORDER BY fouls_per_game DESC, team DESC LIMIT 1) AS most_fouls_per_game_team,
       {fixed_sql('max(fouls_per_game)', 6)} AS max_fouls_per_game,
       {fixed_sql('avg(fouls_per_game)', 6)} AS mean_fouls_per_game
FROM pt""", doubles=["max_fouls_per_game", "mean_fouls_per_game"])
def q17_team_headlines(spark, sf_dir):
    return Q.team_headlines(_ps(spark, sf_dir))


@job("q18_bands", PS + """
SELECT player_name, team, season, risk_score, probability,
       CASE WHEN risk_score >= 8.0 THEN 'high' WHEN risk_score >= 6.0 THEN 'medium' ELSE 'low' END AS risk_band,
       CASE WHEN probability >= 80.0 THEN 'very_likely' WHEN probability >= 60.0 THEN 'likely'
            WHEN probability >= 40.0 THEN 'possible' ELSE 'unlikely' END AS probability_band
FROM (SELECT player_name, team, season,
             least(10.0::DOUBLE, 10.0::DOUBLE * (0.4::DOUBLE * fouls + 0.4::DOUBLE * yellow_cards + 0.2::DOUBLE * red_cards)
                   / greatest(appearances, 1) / 3.0::DOUBLE) AS risk_score,
             100.0::DOUBLE * (1.0::DOUBLE - exp(-(red_cards / CAST(greatest(appearances, 1) AS DOUBLE)) * 50.0::DOUBLE)) AS probability
      FROM player_season) s""", doubles=["risk_score", "probability"])
def q18_bands(spark, sf_dir):
    ps = _ps(spark, sf_dir)
    app = F.greatest(F.col("appearances"), F.lit(1))
    scored = ps.select(
        "player_name", "team", "season",
        F.least(F.lit(10.0), 10.0 * (0.4 * F.col("fouls") + 0.4 * F.col("yellow_cards")
                                     + 0.2 * F.col("red_cards")) / app / 3.0).alias("risk_score"),
        (100.0 * (1.0 - F.exp(-(F.col("red_cards") / F.greatest(F.col("appearances"), F.lit(1.0)))
                              * 50.0))).alias("probability"))
    return scored.select("*", Q.risk_band("risk_score").alias("risk_band"),
                         Q.probability_band("probability").alias("probability_band"))


@job("q21_trailing_period", with_views("player_match", extra={"a": """
  SELECT max(CAST(match_date AS DATE)) AS anchor FROM player_match""", "x": """
  SELECT CAST(p.match_date AS DATE) AS d, p.fouls, p.yellow_cards, p.red_cards, a.anchor FROM player_match p, a""",
     "s": """
  SELECT anchor AS anchor_date,
    CAST(coalesce(sum(fouls) FILTER (WHERE d >= anchor - 90 AND d <= anchor), 0) AS BIGINT) AS fouls_current,
    CAST(coalesce(sum(fouls) FILTER (WHERE d >= anchor - 180 AND d < anchor - 90), 0) AS BIGINT) AS fouls_previous,
    CAST(coalesce(sum(yellow_cards) FILTER (WHERE d >= anchor - 90 AND d <= anchor), 0) AS BIGINT) AS yellow_cards_current,
    CAST(coalesce(sum(yellow_cards) FILTER (WHERE d >= anchor - 180 AND d < anchor - 90), 0) AS BIGINT) AS yellow_cards_previous,
    CAST(coalesce(sum(red_cards) FILTER (WHERE d >= anchor - 90 AND d <= anchor), 0) AS BIGINT) AS red_cards_current,
    CAST(coalesce(sum(red_cards) FILTER (WHERE d >= anchor - 180 AND d < anchor - 90), 0) AS BIGINT) AS red_cards_previous
  FROM x GROUP BY anchor"""}) + """
SELECT *, (fouls_current - fouls_previous) / CAST(nullif(fouls_previous, 0) AS DOUBLE) * 100.0 AS fouls_change_pct,
       (yellow_cards_current - yellow_cards_previous) / CAST(nullif(yellow_cards_previous, 0) AS DOUBLE) * 100.0 AS yellow_cards_change_pct,
       (red_cards_current - red_cards_previous) / CAST(nullif(red_cards_previous, 0) AS DOUBLE) * 100.0 AS red_cards_change_pct,
       '90d' AS period
FROM s""", doubles=["fouls_change_pct", "yellow_cards_change_pct", "red_cards_change_pct"])
def q21_trailing_period(spark, sf_dir):
    """The dates of both periods reach the scan of orders; other lines are not aggregated."""
    period = "90d"
    today = _today(spark, sf_dir)
    if today is None:
        return Q.trailing_period(_pm(spark, sf_dir), period)
    since = datetime.combine(today, datetime.min.time()) - timedelta(days=2 * Q.PERIOD_DAYS[period])
    return Q.trailing_period(TB.player_match(spark, sf_dir, since=since), period, anchor=today)


@job("q22_chart_series", with_views("player_match", extra={"d": """
  SELECT CAST(match_date AS DATE) AS date, CAST(sum(fouls) AS BIGINT) AS value FROM player_match GROUP BY 1"""}) + """
SELECT date, value, coalesce(value * 100.0 / nullif((SELECT max(value) FROM d), 0), 0.0) AS pct_of_max FROM d""",
     doubles=["pct_of_max"])
def q22_chart_series(spark, sf_dir):
    return Q.chart_series(_pm(spark, sf_dir))


@job("q23_team_performance", with_views("player_season", extra={"t": """
  SELECT team, CAST(sum(fouls) AS BIGINT) AS fouls FROM player_season GROUP BY team"""}) + """
SELECT team, fouls, coalesce(fouls * 100.0 / nullif((SELECT max(fouls) FROM t), 0), 0.0) AS pct_of_max FROM t""",
     doubles=["pct_of_max"])
def q23_team_performance(spark, sf_dir):
    return Q.team_performance(_ps(spark, sf_dir))


@job("q24_min_games", PM + """
SELECT * FROM player_match WHERE player_id IN
  (SELECT player_id FROM player_match GROUP BY player_id HAVING count(*) >= 5)""")
def q24_min_games(spark, sf_dir):
    return Q.min_games(_pm(spark, sf_dir), 5)


@job("q25_data_info", PM + """
SELECT count(*) AS rows, count(DISTINCT player_id) AS players, count(DISTINCT team) AS teams,
       min(match_date) AS first_date, max(match_date) AS last_date FROM player_match""")
def q25_data_info(spark, sf_dir):
    return Q.data_info(_pm(spark, sf_dir))


_PREDICTED = {"foul": ("fouls", 20, 10), "yellow_card": ("yellow_cards", 2, 1), "red_card": ("red_cards", 2, 1)}
_PREDICTIONS_SQL = " UNION ALL ".join(
    f"SELECT match_id, player_name, '{t}' AS type, CASE WHEN {c} >= {hi} THEN 'high' WHEN {c} >= {lo} THEN 'medium' ELSE 'low' END "
    f"AS confidence FROM player_match" for t, (c, hi, lo) in _PREDICTED.items())


def _predictions(spark, sf_dir):
    """Prediction rows on a stand-in: one per match and kind, confidence by the count's band."""
    band = lambda c, hi, lo: F.when(F.col(c) >= hi, "high").when(F.col(c) >= lo, "medium").otherwise("low")
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), band(*x).alias("confidence")) for t, x in _PREDICTED.items()])).alias("p")
    return TB.player_match(spark, sf_dir).select("match_id", "player_name", rows).select("match_id", "player_name", "p.*")


@job("q19_prediction_summary", with_views("player_match", extra={"pred": _PREDICTIONS_SQL}) + """
SELECT count(*) AS total, count(*) FILTER (WHERE confidence = 'high') AS high_confidence,
       count(*) FILTER (WHERE type = 'foul') AS foul_predictions, count(*) FILTER (WHERE contains(type, 'card')) AS card_predictions
FROM pred""")
def q19_prediction_summary(spark, sf_dir):
    """Q19: totals over all prediction rows."""
    return Q.prediction_summary(_predictions(spark, sf_dir))


@job("q20_list_predictions", with_views("player_match", extra={"pred": _PREDICTIONS_SQL}) + """
SELECT match_id, player_name, type, confidence FROM pred
WHERE type = 'yellow_card' AND confidence = 'high' AND contains(lower(player_name), '7')""")
def q20_list_predictions(spark, sf_dir):
    """Q20: predictions of one type and confidence, by part of the player's name."""
    return Q.list_predictions(_predictions(spark, sf_dir), "yellow_card", "high", player="7")
