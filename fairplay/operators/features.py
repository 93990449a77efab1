"""Feature engineering on the season table (and F27 on the match table).

Every step is a column expression or an aggregate joined back; no pandas.
Group statistics (team-season, league-season) are computed once as small
aggregates and joined back with a size-checked broadcast instead of a window
over all player rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairplay.functions.numeric import fixed, literal_map, per, safe_div
from fairplay.plans.joins import bounded_broadcast
from fairplay.plans.windows import average_rank_table, trailing_blocks
from fairplay.session import cut_lineage

# Fixed values (must equal the reference's for equal results).
POSITION_NUMBER = {"GK": 0.0, "DF": 1.0, "MF": 2.0, "FW": 3.0,
                   "DF,MF": 1.5, "MF,FW": 2.5, "DF,FW": 2.0}
POSITION_NUMBER_DEFAULT = 2.0
EXPECTED_FOULS = {"GK": 0.2, "DF": 1.5, "MF": 1.2, "FW": 0.8,
                  "DF,MF": 1.35, "MF,FW": 1.0, "DF,FW": 1.15}
EXPECTED_FOULS_DEFAULT = 1.0
LEAGUE_FACTOR = {"Premier League": 1.2, "La Liga": 1.1, "Serie A": 1.3, "Bundesliga": 1.0,
                 "Ligue 1": 1.15, "Brasileirão": 1.4}
LEAGUE_FACTOR_DEFAULT = 1.0
CAREER_EDGES = [0, 23, 28, 32, 50]
CAREER_LABELS = ["young", "prime", "experienced", "veteran"]
EXPERIENCE_EDGES = [0, 10, 25, 35, 100]
EXPERIENCE_LABELS = ["rookie", "developing", "regular", "veteran"]
DEFAULT_AGE = 25
ROLLING_COLUMNS = ["fouls_per_game", "yellow_cards_per_game", "aggression_score"]
ROLLING_WINDOWS = [3, 5]
SCALED_COLUMNS = ["fouls_per_game", "fouls_drawn_per_game", "yellow_cards_per_game",
                  "minutes_per_game", "aggression_score", "fair_play_score", "fouls_vs_expected",
                  "fouls_vs_team_avg", "player_vs_league_fouls"]
ENCODED_COLUMNS = ["team", "league", "career_stage", "experience_level"]
NOT_FEATURES = ["player_name", "team", "league", "season", "position", "fouls", "yellow_cards",
                "red_cards", "fouls_drawn", "appearances", "minutes", "source", "scraped_at",
                "created_at", "updated_at", "id"]
TARGETS = ["fouls", "yellow_cards", "red_cards"]


# ---------------------------------------------------------------- F1-F5
def base_features(df: DataFrame) -> DataFrame:
    app, mins = "appearances", "minutes"
    out = df.withColumns({
        "fouls_per_game": per("fouls", app, 1),
        "fouls_drawn_per_game": per("fouls_drawn", app, 1),
        "yellow_cards_per_game": per("yellow_cards", app, 1),
        "red_cards_per_game": per("red_cards", app, 1),
        "minutes_per_game": per(mins, app, 1),
        "fouls_per_minute": per("fouls", mins, 1) * 90,
        "cards_per_minute": per(F.col("yellow_cards") + F.col("red_cards"), mins, 1) * 90,
        "fouls_drawn_per_minute": per("fouls_drawn", mins, 1) * 90,
        "total_cards": F.col("yellow_cards") + F.col("red_cards"),
    })
    out = out.withColumns({
        "card_to_foul_ratio": per("total_cards", "fouls", 1),
        "foul_balance": F.col("fouls_drawn") - F.col("fouls"),
        "disciplinary_index": per(F.col("yellow_cards") + F.col("red_cards") * 2, app, 1),
        "minutes_percentage": per(mins, F.col(app) * 90, 1),
    })
    return out.withColumns({
        "substitute_indicator": (F.col("minutes_percentage") < 0.7).cast("int"),
        "starter_indicator": (F.col("minutes_percentage") > 0.8).cast("int"),
        "aggression_score": (F.col("fouls_per_game") * 0.4 + F.col("yellow_cards_per_game") * 0.4
                             + F.col("red_cards_per_game") * 0.2),
        "fair_play_score": (F.col("fouls_drawn_per_game") * 0.6 - F.col("fouls_per_game") * 0.3
                            - per("total_cards", app, 1) * 0.1),
    })


# ---------------------------------------------------------------- F6-F8
def positional_features(df: DataFrame, position: str = "position") -> DataFrame:
    pos = F.col(position)

    def has(code: str) -> Column:
        return F.coalesce(pos.contains(code), F.lit(False)).cast("int")

    out = df.withColumns({
        "position_numeric": literal_map(POSITION_NUMBER, pos, POSITION_NUMBER_DEFAULT),
        "is_goalkeeper": F.coalesce(pos == "GK", F.lit(False)).cast("int"),
        "is_defender": has("DF"),
        "is_midfielder": has("MF"),
        "is_forward": has("FW"),
        "is_versatile": has(","),
        "expected_fouls_per_game": literal_map(EXPECTED_FOULS, pos, EXPECTED_FOULS_DEFAULT),
    })
    return out.withColumn("fouls_vs_expected",
                          F.col("fouls_per_game") - F.col("expected_fouls_per_game"))


# ---------------------------------------------------------------- F9-F11
def _group_stats(df: DataFrame, keys: Sequence[str], prefix: str,
                 with_sum: bool, extra_mean: Sequence[str] = ()) -> DataFrame:
    aggs = []
    for c in ("fouls", "yellow_cards", "red_cards", "fouls_drawn"):
        aggs += [fixed(F.avg(c), 3).alias(f"{prefix}_{c}_mean"),
                 fixed(F.stddev_samp(c), 3).alias(f"{prefix}_{c}_std")]
        if with_sum:
            aggs.append(fixed(F.sum(c), 3).alias(f"{prefix}_{c}_sum"))
    for c in extra_mean:
        aggs.append(fixed(F.avg(c), 3).alias(f"{prefix}_{c}_mean"))
    return df.groupBy(*keys).agg(*aggs)


def team_features(df: DataFrame) -> DataFrame:
    """F9 team-season stats joined back, F10 player vs team, F11 average-tie ranks."""
    stats = _group_stats(df, ["team", "season"], "team", True, ["appearances"])
    out = df.join(bounded_broadcast(stats), ["team", "season"], "left")
    out = out.withColumns({
        "fouls_vs_team_avg": F.col("fouls") - F.col("team_fouls_mean"),
        "cards_vs_team_avg": F.col("total_cards") - (F.col("team_yellow_cards_mean")
                                                     + F.col("team_red_cards_mean")),
        "player_team_foul_ratio": per("fouls", "team_fouls_sum", 1),
    })
    # Ranks of the team mean over the *player rows* of a season, ties averaged.
    asc = average_rank_table(out, ["season"], "team_fouls_mean", True, "team_discipline_rank")
    desc = average_rank_table(out, ["season"], "team_fouls_mean", False, "team_aggression_rank")
    ranks = asc.join(desc, ["season", "team_fouls_mean"])
    return out.join(bounded_broadcast(ranks), ["season", "team_fouls_mean"], "left")


# ---------------------------------------------------------------- F12-F14
def league_features(df: DataFrame) -> DataFrame:
    stats = _group_stats(df, ["league", "season"], "league", False)
    out = df.join(bounded_broadcast(stats), ["league", "season"], "left")
    std, mean = F.col("league_fouls_std"), F.col("league_fouls_mean")
    return out.withColumns({
        "league_competitiveness": F.when(std.isNull(), None).otherwise(
            std / F.greatest(mean, F.lit(0.1))),
        "player_vs_league_fouls": F.when(std.isNull(), None).otherwise(
            (F.col("fouls_per_game") - mean) / F.greatest(std, F.lit(0.1))),
        "league_aggression_factor": literal_map(LEAGUE_FACTOR, "league", LEAGUE_FACTOR_DEFAULT),
    })


# ---------------------------------------------------------------- F15-F16
def right_closed_bins(value: str | Column, edges: Sequence[float],
                      labels: Sequence[str]) -> Column:
    """(e0, e1], (e1, e2], ...; outside (including the lowest edge) -> null."""
    v = F.col(value) if isinstance(value, str) else value
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (v > F.lit(lo)) & (v <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def temporal_features(df: DataFrame, season: str = "season") -> DataFrame:
    year = F.substring(F.col(season), 1, 4).try_cast("int")
    out = df.withColumns({
        "season_start_year": year,
        "season_numeric": year - 2000,
        "estimated_age": F.lit(DEFAULT_AGE),
    })
    return out.withColumns({
        "career_stage": right_closed_bins("estimated_age", CAREER_EDGES, CAREER_LABELS),
        "experience_level": right_closed_bins("appearances", EXPERIENCE_EDGES, EXPERIENCE_LABELS),
    })


# ---------------------------------------------------------------- F17
def interaction_features(df: DataFrame) -> DataFrame:
    out = df.withColumns({
        "defender_in_aggressive_league": F.col("is_defender") * F.col("league_aggression_factor"),
        "midfielder_minutes_interaction": F.col("is_midfielder") * F.col("minutes_per_game"),
        "starter_foul_interaction": F.col("starter_indicator") * F.col("fouls_per_game"),
        "substitute_aggression": F.col("substitute_indicator") * F.col("aggression_score"),
        "star_player_indicator": F.coalesce(
            F.col("minutes_per_game") > F.col("team_appearances_mean") * 0.8,
            F.lit(False)).cast("int"),
    })
    return out.withColumn("team_outlier_fouls",
                          F.col("star_player_indicator") * F.col("fouls_vs_team_avg"))


# ---------------------------------------------------------------- F18-F19
def rolling_features(df: DataFrame, windows: Sequence[int] = ROLLING_WINDOWS,
                     columns: Sequence[str] = ROLLING_COLUMNS, player: str = "player_name",
                     order: Sequence[str] = ("season_start_year", "team", "league")) -> DataFrame:
    """Trailing mean (min 1 row) and least-squares slope (min 2 rows) per player.

    All windows share one partitioning and ordering; players are cut into blocks of
    positions with the rows before them, so a hot player is not one task.
    """
    out, base = trailing_blocks(df, [player], order, max(windows) - 1)
    out = out.withColumn("_x", F.col("_pos").cast("double"))
    cols = {}
    for w in windows:
        frame = base.rowsBetween(-(w - 1), 0)
        n = F.count(F.lit(1)).over(frame)
        for c in columns:
            cols[f"{c}_rolling_{w}"] = F.avg(c).over(frame)
            cols[f"{c}_trend_{w}"] = F.when(n >= 2, F.regr_slope(F.col(c), F.col("_x")).over(frame))
    return out.withColumns(cols).where("_halo = 0").drop("_pos", "_x", "_block", "_halo")


# ---------------------------------------------------------------- F20
def fit_encoders(df: DataFrame, columns: Sequence[str] = ENCODED_COLUMNS):
    """StringIndexer per column, alphabetical codes, unseen -> one extra code."""
    from pyspark.ml import Pipeline

    filled = _fill_nan_text(df, columns)
    stages = [StringIndexer(inputCol=f"{c}__txt", outputCol=f"{c}_encoded",
                            stringOrderType="alphabetAsc", handleInvalid="keep")
              for c in columns]
    return Pipeline(stages=stages).fit(filled)


def _fill_nan_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}__txt": F.coalesce(F.col(c).cast("string"), F.lit("nan"))
                           for c in columns})


def encode(df: DataFrame, model, columns: Sequence[str] = ENCODED_COLUMNS) -> DataFrame:
    out = model.transform(_fill_nan_text(df, columns))
    return out.drop(*[f"{c}__txt" for c in columns])


# ---------------------------------------------------------------- F21
def scaled_columns(df: DataFrame) -> list[str]:
    cols = [c for c in SCALED_COLUMNS if c in df.columns]
    cols += [c for c in df.columns if ("rolling" in c or "trend" in c) and c not in cols]
    return cols


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One-row table of mean and population std (ddof 0) per column (the fitted state).

    Taken from (column, value) rows: an aggregate of so many columns side by side is too
    wide for generated code.
    """
    long = _long_values(df, columns).groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    aggs = []
    for c in columns:
        of_c = F.col("feature") == c
        aggs += [F.max(F.when(of_c, F.col(s))).alias(f"{c}__{s}") for s in ("mean", "std")]
    return long.agg(*aggs)


def scale(df: DataFrame, state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std; std 0 or null -> x - mean. Nulls stay null."""
    from fairplay.operators.queries import attach_scalar

    out = attach_scalar(df, state)
    repl = {}
    for c in columns:
        std = F.col(f"{c}__std")
        den = F.when((std.isNull()) | (std == 0), F.lit(1.0)).otherwise(std)
        repl[c] = (F.col(c) - F.col(f"{c}__mean")) / den
    out = out.withColumns(repl)
    return out.drop(*[f"{c}__{s}" for c in columns for s in ("mean", "std")])


# ---------------------------------------------------------------- F22-F25
def numeric_feature_columns(df: DataFrame, target: str,
                            exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    from pyspark.sql.types import NumericType

    skip = set(exclude) | {target, "player_id", "season_start_year"}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in skip]


def _long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, feature, x): a row per row and column, x as double."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.x")


def _unpivot_scores(df_one_row: DataFrame, features: Sequence[str], prefix: str,
                    name: str) -> DataFrame:
    pairs = ", ".join(f"'{f}', `{prefix}{f}`" for f in features)
    return df_one_row.selectExpr(f"stack({len(features)}, {pairs}) as (feature, {name})")


def feature_scores(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """F22 scores: F = r^2 / (1 - r^2) * (n - 2), nulls as 0; one pass over the rows.

    Each row gives a (feature, value, target) row per feature, added up by feature.
    """
    long = _long_values(df.withColumn("_y", F.col(target).cast("double")), features, ["_y"])
    scores = long.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"), F.regr_r2(F.col("_y"), F.coalesce(F.col("x"), F.lit(0.0))).alias("r2"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")  # no rows: all scores 0
    scored = names.join(scores, "feature", "left").select(
        "feature",
        fixed(F.coalesce(safe_div(F.col("r2") * (F.col("_n") - 2), 1.0 - F.col("r2"), None),
                         F.lit(0.0)), 6).alias("f_score"))
    w = Window.orderBy(F.col("f_score").desc(), "feature")
    return scored.withColumn("rank", F.row_number().over(w))


def select_features(df: DataFrame, target: str, k: int = 50,
                    id_cols: Sequence[str] = ("player_id", "player_name", "team", "league",
                                              "season"), scored_on: Column | None = None) -> tuple[DataFrame, list[str]]:
    """keep the k best-scoring numeric features + target + ids.

    ``scored_on``: the rows that the scores are taken from (all, if not given). Only the k
    feature names (column-count sized) reach the driver.
    """
    features = numeric_feature_columns(df, target)
    scores = feature_scores(df if scored_on is None else df.where(scored_on), target, features)
    keep = [r.feature for r in scores.where(F.col("rank") <= k).orderBy("rank").collect()]
    ids = [c for c in id_cols if c in df.columns]
    return df.select(*ids, *keep, target), keep


def feature_correlation(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """|Pearson r| per feature, descending (null when a side is constant)."""
    y = F.col(target).cast("double")
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs.append(fixed(F.abs(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))), 6)
                    .alias(f"c_{f}"))
    long = _unpivot_scores(df.agg(*aggs), features, "c_", "abs_corr")
    w = Window.orderBy(F.col("abs_corr").desc_nulls_last(), "feature")
    return long.withColumn("rank", F.row_number().over(w))


def feature_mutual_info(df: DataFrame, target: str, features: Sequence[str],
                        bins: int = 10) -> DataFrame:
    """F24 (re-aimed): mutual information on equal-width bins, descending.

    Unpivots (row, feature) once, bins by each feature's [min, max], counts
    (feature, bx, by) cells with map-side partial aggregation and sums
    p log(p / (px py)). Differs from a kNN estimate; same ranking purpose.
    """
    y = F.col(target).cast("double")
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    long = df.select(y.alias("_y"), F.expr(f"stack({len(features)}, {pairs}) as (feature, x)"))
    long = long.where(F.col("x").isNotNull() & F.col("_y").isNotNull())
    ranges = long.groupBy("feature").agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi"),
                                         F.min("_y").alias("y_lo"), F.max("_y").alias("y_hi"),
                                         F.count(F.lit(1)).alias("n"))

    def bin_of(v: str, lo: str, hi: str) -> Column:
        width = F.col(hi) - F.col(lo)
        raw = F.floor((F.col(v) - F.col(lo)) / F.when(width == 0, F.lit(1.0)).otherwise(width) * bins)
        return F.least(raw, F.lit(bins - 1))

    binned = long.join(bounded_broadcast(ranges), "feature").select(
        "feature", "n", bin_of("x", "x_lo", "x_hi").alias("bx"), bin_of("_y", "y_lo", "y_hi").alias("by"))
    cells = binned.groupBy("feature", "n", "bx", "by").agg(F.count(F.lit(1)).alias("nxy"))
    wx = Window.partitionBy("feature", "bx")
    wy = Window.partitionBy("feature", "by")
    cells = cells.withColumns({"nx": F.sum("nxy").over(wx), "ny": F.sum("nxy").over(wy)})
    nxy, n = F.col("nxy").cast("double"), F.col("n").cast("double")
    term = (nxy / n) * F.log(nxy * n / (F.col("nx").cast("double") * F.col("ny").cast("double")))
    mi = cells.groupBy("feature").agg(fixed(F.sum(term), 6).alias("mutual_info"))
    w = Window.orderBy(F.col("mutual_info").desc(), "feature")
    return mi.withColumn("rank", F.row_number().over(w))


def target_stats(df: DataFrame, target: str, n_features: int) -> DataFrame:
    """mean, std (ddof 1), min, max of the target and the feature count."""
    y = F.col(target).cast("double")
    return df.agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
                  F.min(y).alias("min"), F.max(y).alias("max")).withColumn(
        "feature_count", F.lit(n_features))


# ---------------------------------------------------------------- F1-F19 chain, F26
def season_features(df: DataFrame) -> DataFrame:
    """F1..F19 in the reference's order (before encoding/scaling/selection)."""
    out = base_features(df)
    out = positional_features(out)
    out = team_features(out)
    out = league_features(out)
    out = temporal_features(out)
    out = interaction_features(out)
    return rolling_features(out)


def split_flag(id_cols: Sequence[str], seed: int = 42, test_share: float = 0.2) -> Column:
    """Repeatable 80/20 split flag from a hash of the row key (any partitioning)."""
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed)), F.lit(1000))
    return F.when(bucket < int(test_share * 1000), "test").otherwise("train")


def create_all_features(df: DataFrame, target: str = "fouls", k: int = 50,
                        id_cols: Sequence[str] = ("player_name", "team", "season", "league")):
    """F1..F22 then a repeatable 80/20 split.

    Returns (frame with ``split`` column, fitted encoder model, scaler state,
    selected feature names). Encoders, scaler and selection are fitted on the train rows;
    the rows are materialised once, as each of these fits reads them.
    """
    feats = cut_lineage(season_features(cut_lineage(df)).withColumn("split", split_flag(id_cols)))
    train = feats.where(F.col("split") == "train")
    enc = fit_encoders(train)
    feats = encode(feats, enc)
    cols = scaled_columns(feats)
    state = fit_scaler(feats.where(F.col("split") == "train"), cols)
    feats = scale(feats, state, cols)
    selected, keep = select_features(feats, target, k,
                                     id_cols=("player_id", *id_cols, "split"), scored_on=F.col("split") == "train")
    return selected, enc, state, keep


# ---------------------------------------------------------------- F27
def lookback_features(pm: DataFrame, n: int = 10) -> DataFrame:
    """per (player, match) trailing form over the previous n games (current
    row excluded), opponent and own team-season form, calendar fields, targets."""
    blocked, base = trailing_blocks(pm, ["player_id"], ["match_date", "match_id"], n)
    w = base.rowsBetween(-n, -1)
    out = blocked.withColumns({
        f"form_{c}_{n}": F.avg(c).over(w) for c in ("fouls", "yellow_cards", "red_cards",
                                                     "fouls_drawn", "minutes_played")
    }).withColumn(f"games_in_form_{n}", F.count(F.lit(1)).over(w)).where("_halo = 0").drop("_pos", "_block", "_halo")
    team_form = pm.groupBy("team_id", "season_start_year").agg(
        F.avg("fouls").alias("team_fouls_avg"),
        F.avg(F.col("yellow_cards") + F.col("red_cards")).alias("team_cards_avg"))
    opp = team_form.select(F.col("team_id").alias("opponent_id"), "season_start_year",
                           F.col("team_fouls_avg").alias("opponent_fouls_avg"),
                           F.col("team_cards_avg").alias("opponent_cards_avg"))
    out = out.withColumn("opponent_id", F.when(F.col("team_id") == F.col("home_team_id"),
                                               F.col("away_team_id")).otherwise(F.col("home_team_id")))
    out = (out.join(bounded_broadcast(team_form), ["team_id", "season_start_year"], "left")
           .join(bounded_broadcast(opp), ["opponent_id", "season_start_year"], "left"))
    return out.withColumns({
        "month": F.month("match_date"),
        "day_of_week": F.dayofweek("match_date"),
        "is_home": (F.col("team_id") == F.col("home_team_id")).cast("int"),
        "target_fouls": F.col("fouls"),
        "target_yellow_cards": F.col("yellow_cards"),
        "target_red_cards": F.col("red_cards"),
    })
