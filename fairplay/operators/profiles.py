"""Per-player profile from the match table.

One hash aggregation per player computes P1-P5, P7, P8 with conditional
aggregates (one pass instead of a group-by per feature); P6 (mean of the
per-team means) is a second, two-level aggregation. Both outputs are hash
partitioned on the player key, so joining them adds no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values (must equal the reference's for equal results).
EARLY_MONTHS = [8, 9, 10]
LATE_MONTHS = [4, 5, 6]
POSITION_CODES = ["GK", "DF", "MF", "FW", "DF,MF", "MF,FW", "DF,FW"]


def position_column(code: str) -> str:
    return "pos_" + code.replace(",", "_")


def player_profile(pm: DataFrame, player: str = "player_id", team: str = "team",
                   date: str = "match_date", order_key: str = "match_id",
                   minutes: str = "minutes_played") -> DataFrame:
    month = F.month(date)
    main = pm.groupBy(player).agg(
        F.avg("fouls").alias("avg_fouls_per_game"),
        F.avg("yellow_cards").alias("avg_yellow_cards_per_game"),
        F.avg("red_cards").alias("avg_red_cards_per_game"),
        F.sum("fouls").alias("total_fouls"),
        F.sum("yellow_cards").alias("total_yellow_cards"),
        F.sum("red_cards").alias("total_red_cards"),
        F.sum(minutes).alias("_minutes"),
        F.coalesce(F.stddev_samp("fouls"), F.lit(0.0)).alias("fouls_std"),
        F.avg(F.when(month.isin(EARLY_MONTHS), F.col("fouls"))).alias("_early"),
        F.avg(F.when(month.isin(LATE_MONTHS), F.col("fouls"))).alias("_late"),
        # First known position in match order.
        F.expr(f"min_by(position, struct({date}, {order_key})) FILTER (WHERE position IS NOT NULL)")
        .alias("_first_position"),
        F.count_if(F.col("fouls") >= 3).alias("high_foul_games"),
        F.count_if((F.col("yellow_cards") > 0) | (F.col("red_cards") > 0)).alias("card_games"),
    )
    per_team = (pm.groupBy(player, team).agg(F.avg("fouls").alias("_team_mean"))
                .groupBy(player).agg(F.avg("_team_mean").alias("team_avg_fouls")))
    out = main.join(per_team, player, "left")
    cards = F.col("total_yellow_cards") + F.col("total_red_cards")
    cols = {
        "fouls_per_minute": F.coalesce(F.try_divide(F.col("total_fouls").cast("double"),
                                                    F.col("_minutes").cast("double")), F.lit(0.0)),
        "cards_per_minute": F.coalesce(F.try_divide(cards.cast("double"),
                                                    F.col("_minutes").cast("double")), F.lit(0.0)),
        "fouls_cv": F.coalesce(F.try_divide(F.col("fouls_std"), F.col("avg_fouls_per_game")),
                               F.lit(0.0)),
        "fouls_early_season": F.coalesce(F.col("_early"), F.col("avg_fouls_per_game")),
        "fouls_late_season": F.coalesce(F.col("_late"), F.col("avg_fouls_per_game")),
        "disciplinary_points": F.col("total_yellow_cards") + F.col("total_red_cards") * 2,
        "foul_to_card_ratio": F.col("total_fouls") / (cards + 1),
    }
    for code in POSITION_CODES:
        cols[position_column(code)] = F.coalesce(
            (F.col("_first_position") == code).cast("int"), F.lit(0))
    out = out.withColumns(cols)
    return out.drop("_minutes", "_early", "_late", "_first_position")


PROFILE_FEATURES = [
    "avg_fouls_per_game", "avg_yellow_cards_per_game", "avg_red_cards_per_game", "total_fouls",
    "total_yellow_cards", "total_red_cards", "fouls_per_minute", "cards_per_minute", "fouls_std",
    "fouls_cv", "fouls_early_season", "fouls_late_season",
    *[position_column(c) for c in POSITION_CODES],
    "team_avg_fouls", "disciplinary_points", "foul_to_card_ratio", "high_foul_games", "card_games",
]
