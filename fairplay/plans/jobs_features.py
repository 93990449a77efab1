"""Registered jobs for feature engineering (F1-F27) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairplay.operators import features as FE
from fairplay.plans.catalog import job
from fairplay.plans.oracle import fixed_sql, with_views
from fairplay.session import cut_lineage
from fairplay.sources import tables as TB


def _case_map(col: str, mapping: dict, default: float) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"CAST(CASE {col} {arms} ELSE {default!r} END AS DOUBLE)"


def _bins_sql(col: str, edges, labels) -> str:
    arms = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{lab}'"
                    for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {arms} END"


def _stats_sql(src: str, keys: str, prefix: str, with_sum: bool, extra_mean=()) -> str:
    parts = []
    for c in ("fouls", "yellow_cards", "red_cards", "fouls_drawn"):
        parts.append(f"{fixed_sql(f'avg({c})', 3)} AS {prefix}_{c}_mean")
        parts.append(f"{fixed_sql(f'stddev_samp({c})', 3)} AS {prefix}_{c}_std")
        if with_sum:
            parts.append(f"{fixed_sql(f'sum({c})', 3)} AS {prefix}_{c}_sum")
    for c in extra_mean:
        parts.append(f"{fixed_sql(f'avg({c})', 3)} AS {prefix}_{c}_mean")
    return f"SELECT {keys}, {', '.join(parts)} FROM {src} GROUP BY {keys}"


_ROLL_ORDER = "PARTITION BY player_name ORDER BY season_start_year, team, league"


def _rolling_sql() -> str:
    cols = []
    for w in FE.ROLLING_WINDOWS:
        frame = f"({_ROLL_ORDER} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for c in FE.ROLLING_COLUMNS:
            cols.append(f"avg({c}) OVER {frame} AS {c}_rolling_{w}")
            cols.append(f"CASE WHEN count(*) OVER {frame} >= 2 THEN regr_slope({c}, _pos) OVER {frame} END "
                        f"AS {c}_trend_{w}")
    return (f"SELECT * EXCLUDE (_pos) FROM (SELECT *, {', '.join(cols)} FROM "
            f"(SELECT *, CAST(row_number() OVER ({_ROLL_ORDER}) AS DOUBLE) AS _pos FROM feat_inter) r0) r1")


FEATURE_CTES = {
    "b1": """
  SELECT *,
    fouls / greatest(appearances, 1) AS fouls_per_game,
    fouls_drawn / greatest(appearances, 1) AS fouls_drawn_per_game,
    yellow_cards / greatest(appearances, 1) AS yellow_cards_per_game,
    red_cards / greatest(appearances, 1) AS red_cards_per_game,
    minutes / greatest(appearances, 1) AS minutes_per_game,
    fouls / greatest(minutes, 1) * 90 AS fouls_per_minute,
    (yellow_cards + red_cards) / greatest(minutes, 1) * 90 AS cards_per_minute,
    fouls_drawn / greatest(minutes, 1) * 90 AS fouls_drawn_per_minute,
    yellow_cards + red_cards AS total_cards
  FROM player_season""",
    "b2": """
  SELECT *,
    total_cards / greatest(fouls, 1) AS card_to_foul_ratio,
    fouls_drawn - fouls AS foul_balance,
    (yellow_cards + red_cards * 2) / greatest(appearances, 1) AS disciplinary_index,
    minutes / greatest(appearances * 90, 1) AS minutes_percentage
  FROM b1""",
    "feat_base": """
  SELECT *,
    CAST(minutes_percentage < 0.7 AS INTEGER) AS substitute_indicator,
    CAST(minutes_percentage > 0.8 AS INTEGER) AS starter_indicator,
    fouls_per_game * 0.4::DOUBLE + yellow_cards_per_game * 0.4::DOUBLE + red_cards_per_game * 0.2::DOUBLE AS aggression_score,
    fouls_drawn_per_game * 0.6::DOUBLE - fouls_per_game * 0.3::DOUBLE
      - total_cards / greatest(appearances, 1) * 0.1::DOUBLE AS fair_play_score
  FROM b2""",
    "p1": f"""
  SELECT *,
    {_case_map('position', FE.POSITION_NUMBER, FE.POSITION_NUMBER_DEFAULT)} AS position_numeric,
    CAST(coalesce(position = 'GK', false) AS INTEGER) AS is_goalkeeper,
    CAST(coalesce(contains(position, 'DF'), false) AS INTEGER) AS is_defender,
    CAST(coalesce(contains(position, 'MF'), false) AS INTEGER) AS is_midfielder,
    CAST(coalesce(contains(position, 'FW'), false) AS INTEGER) AS is_forward,
    CAST(coalesce(contains(position, ','), false) AS INTEGER) AS is_versatile,
    {_case_map('position', FE.EXPECTED_FOULS, FE.EXPECTED_FOULS_DEFAULT)} AS expected_fouls_per_game
  FROM feat_base""",
    "feat_pos": "SELECT *, fouls_per_game - expected_fouls_per_game AS fouls_vs_expected FROM p1",
    "team_stats": _stats_sql("feat_pos", "team, season", "team", True, ["appearances"]),
    "t1": """
  SELECT *,
    fouls - team_fouls_mean AS fouls_vs_team_avg,
    total_cards - (team_yellow_cards_mean + team_red_cards_mean) AS cards_vs_team_avg,
    fouls / greatest(team_fouls_sum, 1.0::DOUBLE) AS player_team_foul_ratio
  FROM feat_pos LEFT JOIN team_stats USING (team, season)""",
    "feat_team": """
  SELECT *,
    CAST(rank() OVER (PARTITION BY season ORDER BY team_fouls_mean) AS DOUBLE)
      + (count(*) OVER (PARTITION BY season, team_fouls_mean) - 1) / 2.0 AS team_discipline_rank,
    CAST(rank() OVER (PARTITION BY season ORDER BY team_fouls_mean DESC) AS DOUBLE)
      + (count(*) OVER (PARTITION BY season, team_fouls_mean) - 1) / 2.0 AS team_aggression_rank
  FROM t1""",
    "league_stats": _stats_sql("feat_team", "league, season", "league", False),
    "feat_league": f"""
  SELECT *,
    CASE WHEN league_fouls_std IS NULL THEN NULL
         ELSE league_fouls_std / greatest(league_fouls_mean, 0.1::DOUBLE) END AS league_competitiveness,
    CASE WHEN league_fouls_std IS NULL THEN NULL
         ELSE (fouls_per_game - league_fouls_mean) / greatest(league_fouls_std, 0.1::DOUBLE) END AS player_vs_league_fouls,
    {_case_map('league', FE.LEAGUE_FACTOR, FE.LEAGUE_FACTOR_DEFAULT)} AS league_aggression_factor
  FROM feat_team LEFT JOIN league_stats USING (league, season)""",
    "tm1": f"""
  SELECT * REPLACE (TRY_CAST(substring(season, 1, 4) AS INTEGER) AS season_start_year),
    {FE.DEFAULT_AGE} AS estimated_age
  FROM feat_league""",
    "feat_temporal": f"""
  SELECT *, season_start_year - 2000 AS season_numeric,
    {_bins_sql('estimated_age', FE.CAREER_EDGES, FE.CAREER_LABELS)} AS career_stage,
    {_bins_sql('appearances', FE.EXPERIENCE_EDGES, FE.EXPERIENCE_LABELS)} AS experience_level
  FROM tm1""",
    "i1": """
  SELECT *,
    is_defender * league_aggression_factor AS defender_in_aggressive_league,
    is_midfielder * minutes_per_game AS midfielder_minutes_interaction,
    starter_indicator * fouls_per_game AS starter_foul_interaction,
    substitute_indicator * aggression_score AS substitute_aggression,
    CAST(coalesce(minutes_per_game > team_appearances_mean * 0.8::DOUBLE, false) AS INTEGER) AS star_player_indicator
  FROM feat_temporal""",
    "feat_inter": "SELECT *, star_player_indicator * fouls_vs_team_avg AS team_outlier_fouls FROM i1",
    "feat_roll": _rolling_sql(),
}
_ORDER = list(FEATURE_CTES)


def features_upto(name: str, extra: dict[str, str] | None = None) -> str:
    ctes = {k: FEATURE_CTES[k] for k in _ORDER[: _ORDER.index(name) + 1]}
    ctes.update(extra or {})
    return with_views("player_season", extra=ctes)


def _ps(spark, sf_dir):
    """The season table, materialised once: the feature chain reads it from
    several branches (team, league and rank aggregates joined back)."""
    return cut_lineage(TB.player_season(spark, sf_dir))


@job("f01_f05_base_features", features_upto("feat_base") + "SELECT * FROM feat_base")
def f01_f05_base_features(spark, sf_dir):
    return FE.base_features(_ps(spark, sf_dir))


@job("f06_f08_positional_features", features_upto("feat_pos") + "SELECT * FROM feat_pos")
def f06_f08_positional_features(spark, sf_dir):
    return FE.positional_features(FE.base_features(_ps(spark, sf_dir)))


def _upto_team(spark, sf_dir):
    return FE.team_features(FE.positional_features(FE.base_features(_ps(spark, sf_dir))))


@job("f09_f11_team_features", features_upto("feat_team") + "SELECT * FROM feat_team")
def f09_f11_team_features(spark, sf_dir):
    return _upto_team(spark, sf_dir)


@job("f12_f14_league_features", features_upto("feat_league") + "SELECT * FROM feat_league")
def f12_f14_league_features(spark, sf_dir):
    return FE.league_features(_upto_team(spark, sf_dir))


def _upto_inter(spark, sf_dir):
    return FE.interaction_features(FE.temporal_features(FE.league_features(_upto_team(spark, sf_dir))))


@job("f15_f16_temporal_features", features_upto("feat_temporal") + "SELECT * FROM feat_temporal")
def f15_f16_temporal_features(spark, sf_dir):
    return FE.temporal_features(FE.league_features(_upto_team(spark, sf_dir)))


@job("f17_interaction_features", features_upto("feat_inter") + "SELECT * FROM feat_inter")
def f17_interaction_features(spark, sf_dir):
    return _upto_inter(spark, sf_dir)


@job("f18_f19_rolling_features", features_upto("feat_roll") + "SELECT * FROM feat_roll")
def f18_f19_rolling_features(spark, sf_dir):
    return FE.season_features(_ps(spark, sf_dir))


_ENC_COLS = FE.ENCODED_COLUMNS


@job("f20_label_encoding", features_upto("feat_roll") + "SELECT player_id, season, "
     + ", ".join(_ENC_COLS) + ", "
     + ", ".join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS DOUBLE) AS {c}_encoded"
                 for c in _ENC_COLS) + " FROM feat_roll")
def f20_label_encoding(spark, sf_dir):
    feats = FE.season_features(_ps(spark, sf_dir)).select("player_id", "season", *_ENC_COLS)
    model = FE.fit_encoders(feats)
    return FE.encode(feats, model)


_SCALED = FE.SCALED_COLUMNS + [f"{c}_{kind}_{w}" for w in FE.ROLLING_WINDOWS
                               for c in FE.ROLLING_COLUMNS for kind in ("rolling", "trend")]


def _scaled_sql(c: str) -> str:
    std = f"stddev_pop({c}) OVER ()"
    return (f"({c} - avg({c}) OVER ()) / (CASE WHEN {std} IS NULL OR {std} = 0 THEN 1.0::DOUBLE "
            f"ELSE {std} END) AS {c}")


@job("f21_standard_scaling", features_upto("feat_roll") + "SELECT player_id, season, "
     + ", ".join(_scaled_sql(c) for c in _SCALED) + " FROM feat_roll")
def f21_standard_scaling(spark, sf_dir):
    feats = FE.season_features(_ps(spark, sf_dir)).select("player_id", "season", *_SCALED)
    cols = FE.scaled_columns(feats)
    return FE.scale(feats, FE.fit_scaler(feats, cols), cols)


# Numeric features of the F1..F19 frame scored against a target.
SCORED_FEATURES = [
    "fouls_per_game", "fouls_drawn_per_game", "yellow_cards_per_game", "red_cards_per_game",
    "minutes_per_game", "fouls_per_minute", "cards_per_minute", "fouls_drawn_per_minute",
    "total_cards", "card_to_foul_ratio", "foul_balance", "disciplinary_index",
    "minutes_percentage", "substitute_indicator", "starter_indicator", "aggression_score",
    "fair_play_score", "position_numeric", "is_goalkeeper", "is_defender", "is_midfielder",
    "is_forward", "is_versatile", "expected_fouls_per_game", "fouls_vs_expected",
    "team_fouls_mean", "team_fouls_std", "team_fouls_sum", "team_yellow_cards_mean",
    "team_red_cards_mean", "team_appearances_mean", "fouls_vs_team_avg", "cards_vs_team_avg",
    "player_team_foul_ratio", "team_discipline_rank", "team_aggression_rank",
    "league_fouls_mean", "league_fouls_std", "league_competitiveness", "player_vs_league_fouls",
    "season_numeric", "star_player_indicator", "team_outlier_fouls",
    "fouls_per_game_rolling_3", "fouls_per_game_trend_3", "aggression_score_rolling_5",
    "aggression_score_trend_5",
]
TARGET = "fouls"


def _union_features(select_for) -> str:
    return "\n  UNION ALL\n".join(select_for(f) for f in SCORED_FEATURES)


_F22_LONG = _union_features(
    lambda f: f"  SELECT '{f}' AS feature, regr_r2(CAST({TARGET} AS DOUBLE), coalesce(CAST({f} AS DOUBLE), 0.0::DOUBLE)) AS r2, "
              f"count(*) AS n FROM feat_roll")


@job("f22_feature_scores", features_upto("feat_roll", {"r2s": _F22_LONG}) + f"""
SELECT feature, f_score, CAST(row_number() OVER (ORDER BY f_score DESC, feature) AS INTEGER) AS rank
FROM (SELECT feature, {fixed_sql('coalesce(r2 * (n - 2) / nullif(1.0::DOUBLE - r2, 0), 0.0::DOUBLE)', 6)} AS f_score FROM r2s) s""",
     doubles=["f_score"])
def f22_feature_scores(spark, sf_dir):
    feats = FE.season_features(_ps(spark, sf_dir))
    return FE.feature_scores(feats, TARGET, SCORED_FEATURES)


_F23_LONG = _union_features(
    lambda f: f"  SELECT '{f}' AS feature, abs(covar_pop(CAST({f} AS DOUBLE), CAST({TARGET} AS DOUBLE)) / "
              f"nullif(stddev_pop(CAST({f} AS DOUBLE)) * stddev_pop(CAST({TARGET} AS DOUBLE)), 0)) AS abs_corr FROM feat_roll")


@job("f23_feature_correlation", features_upto("feat_roll", {"cs": _F23_LONG}) + f"""
SELECT feature, abs_corr, CAST(row_number() OVER (ORDER BY abs_corr DESC NULLS LAST, feature) AS INTEGER) AS rank
FROM (SELECT feature, {fixed_sql('abs_corr', 6)} AS abs_corr FROM cs) c""",
     doubles=["abs_corr"])
def f23_feature_correlation(spark, sf_dir):
    feats = FE.season_features(_ps(spark, sf_dir))
    return FE.feature_correlation(feats, TARGET, SCORED_FEATURES)


_F24_LONG = _union_features(
    lambda f: f"  SELECT '{f}' AS feature, CAST({TARGET} AS DOUBLE) AS _y, CAST({f} AS DOUBLE) AS x FROM feat_roll")
_MI_BINS = 10


def _bin_sql(v: str, lo: str, hi: str) -> str:
    width = f"(CASE WHEN {hi} - {lo} = 0 THEN 1.0::DOUBLE ELSE {hi} - {lo} END)"
    return f"least(floor(({v} - {lo}) / {width} * {_MI_BINS}), {_MI_BINS - 1})"


@job("f24_feature_mutual_info", features_upto("feat_roll", {
    "lng": f"SELECT * FROM ({_F24_LONG}) u WHERE x IS NOT NULL AND _y IS NOT NULL",
    "rng": "SELECT feature, min(x) AS x_lo, max(x) AS x_hi, min(_y) AS y_lo, max(_y) AS y_hi, count(*) AS n FROM lng GROUP BY feature",
    "cells": f"""SELECT feature, n, bin_x, bin_y, count(*) AS nxy FROM (
        SELECT l.feature, r.n, {_bin_sql('l.x', 'r.x_lo', 'r.x_hi')} AS bin_x, {_bin_sql('l._y', 'r.y_lo', 'r.y_hi')} AS bin_y
        FROM lng l JOIN rng r USING (feature)) b GROUP BY feature, n, bin_x, bin_y""",
    "c2": "SELECT *, sum(nxy) OVER (PARTITION BY feature, bin_x) AS nx, sum(nxy) OVER (PARTITION BY feature, bin_y) AS ny FROM cells",
}) + f"""
SELECT feature, mutual_info, CAST(row_number() OVER (ORDER BY mutual_info DESC, feature) AS INTEGER) AS rank
FROM (SELECT feature, {fixed_sql('sum((CAST(nxy AS DOUBLE) / n) * ln(CAST(nxy AS DOUBLE) * n / (CAST(nx AS DOUBLE) * ny)))', 6)} AS mutual_info
      FROM c2 GROUP BY feature) m""", doubles=["mutual_info"])
def f24_feature_mutual_info(spark, sf_dir):
    feats = FE.season_features(_ps(spark, sf_dir))
    return FE.feature_mutual_info(feats, TARGET, SCORED_FEATURES, bins=_MI_BINS)


@job("f25_target_stats", with_views("player_season") + f"""
SELECT avg(CAST({TARGET} AS DOUBLE)) AS mean, stddev_samp(CAST({TARGET} AS DOUBLE)) AS std,
       min(CAST({TARGET} AS DOUBLE)) AS min, max(CAST({TARGET} AS DOUBLE)) AS max,
       {len(SCORED_FEATURES)} AS feature_count FROM player_season""",
     doubles=["mean", "std", "min", "max"])
def f25_target_stats(spark, sf_dir):
    return FE.target_stats(_ps(spark, sf_dir), TARGET, len(SCORED_FEATURES))


@job("f26_create_all_features")
def f26_create_all_features(spark, sf_dir):
    """F26 (property-checked): full chain, encoders/scaler fitted on the train split."""
    selected, _, _, _ = FE.create_all_features(_ps(spark, sf_dir), TARGET, k=50)
    return selected


_F27_W = "(PARTITION BY player_id ORDER BY match_date, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


@job("f27_lookback_features", with_views("player_match", extra={
    "tf": """SELECT team_id, season_start_year, avg(fouls) AS team_fouls_avg,
                    avg(yellow_cards + red_cards) AS team_cards_avg FROM player_match GROUP BY 1, 2""",
    "lb": "SELECT *, " + ", ".join(f"avg({c}) OVER {_F27_W} AS form_{c}_10" for c in
                                   ("fouls", "yellow_cards", "red_cards", "fouls_drawn", "minutes_played"))
          + f", count(*) OVER {_F27_W} AS games_in_form_10,"
          + " CASE WHEN team_id = home_team_id THEN away_team_id ELSE home_team_id END AS opponent_id"
          + " FROM player_match"}) + """
SELECT lb.*, tf.team_fouls_avg, tf.team_cards_avg,
       o.team_fouls_avg AS opponent_fouls_avg, o.team_cards_avg AS opponent_cards_avg,
       CAST(month(lb.match_date) AS INTEGER) AS month, CAST(dayofweek(lb.match_date) + 1 AS INTEGER) AS day_of_week,
       CAST(lb.team_id = lb.home_team_id AS INTEGER) AS is_home,
       lb.fouls AS target_fouls, lb.yellow_cards AS target_yellow_cards, lb.red_cards AS target_red_cards
FROM lb LEFT JOIN tf ON lb.team_id = tf.team_id AND lb.season_start_year = tf.season_start_year
        LEFT JOIN tf o ON lb.opponent_id = o.team_id AND lb.season_start_year = o.season_start_year""",
     doubles=["form_fouls_10", "form_yellow_cards_10", "form_red_cards_10", "form_fouls_drawn_10",
              "form_minutes_played_10", "team_fouls_avg", "team_cards_avg", "opponent_fouls_avg",
              "opponent_cards_avg"])
def f27_lookback_features(spark, sf_dir):
    return FE.lookback_features(TB.player_match(spark, sf_dir), 10)
