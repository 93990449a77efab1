"""Registered validation jobs (V1-V10) over the season table as one load batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairplay.operators import rules as R
from fairplay.plans.catalog import job
from fairplay.plans.jobs_text import _q, _rx
from fairplay.plans.oracle import with_views
from fairplay.sources import tables as TB
from fairplay.functions import text as TX

CURRENT_YEAR = 2026
PATCH_SEASON = "2001-2002"
PATCH_TS = "2024-06-01 00:00:00"


def _batch(spark, sf_dir):
    ps = TB.player_season(spark, sf_dir)
    return ps.withColumn("season", R.season_short("season")).withColumn("source", F.lit("tpch"))


def _collapse_sql(x: str) -> str:
    return _rx(_rx(x, TX.WHITESPACE_CLASS + "+", " "), "^ | $", "")


def _z(c: str) -> str:
    return f"coalesce({c}, 0)"


def _rules_sql() -> list[tuple[str, str]]:
    fmt = f"coalesce(regexp_matches(season, {_q(R.SEASON_PATTERN)}), false)"
    start = "TRY_CAST(substring(season, 1, 4) AS INTEGER)"
    end = "(2000 + TRY_CAST(substring(season, 6, 2) AS INTEGER))"
    out = [
        ("player_name_length", "length(player_name) BETWEEN 2 AND 255"),
        ("player_name_blank", f"player_name IS NOT NULL AND length({_collapse_sql('player_name')}) > 0"),
        ("player_name_chars", f"coalesce(regexp_matches({_collapse_sql('player_name')}, {_q(R.NAME_PATTERN)}), false)"),
        ("team_length", "coalesce(length(team) BETWEEN 2 AND 255, false)"),
        ("team_blank", f"team IS NOT NULL AND length({_collapse_sql('team')}) > 0"),
        ("league_length", "coalesce(length(league) BETWEEN 2 AND 100, false)"),
        ("league_blank", f"league IS NOT NULL AND length({_collapse_sql('league')}) > 0"),
        ("season_format", fmt),
        ("season_consecutive", f"CASE WHEN {fmt} THEN {end} = {start} + 1 ELSE false END"),
        ("season_range", f"CASE WHEN {fmt} THEN {start} BETWEEN 1990 AND {CURRENT_YEAR + 1} ELSE false END"),
    ]
    for c, (lo, hi) in R.RANGES.items():
        out.append((f"{c}_range", f"{_z(c)} BETWEEN {lo} AND {hi}"))
    app = _z("appearances")
    out += [
        ("fouls_per_game_cap", f"({app} <= 0) OR ({_z('fouls')} <= {app} * 20)"),
        ("yellow_per_game_cap", f"({app} <= 0) OR ({_z('yellow_cards')} <= {app} * 3)"),
        ("minutes_per_game_cap", f"({app} <= 0) OR ({_z('minutes')} <= {app} * 120)"),
        ("red_le_appearances", f"{_z('red_cards')} <= {app}"),
        ("zero_appearance_stats", f"({app} <> 0) OR ({_z('minutes')} <= 0 AND {_z('fouls')} <= 0 "
                                  f"AND {_z('yellow_cards')} <= 0 AND {_z('red_cards')} <= 0)"),
        ("cards_vs_fouls", f"NOT (({_z('yellow_cards')} + {_z('red_cards')} > {_z('fouls')}) AND ({_z('fouls')} > 0) "
                           f"AND ({_z('yellow_cards')} + {_z('red_cards')} > {_z('fouls')} * 2))"),
        ("position_code", f"position IS NULL OR position IN ({', '.join(_q(p) for p in R.POSITIONS)})"),
        ("source_id", f"coalesce(regexp_matches(source, {_q(R.SOURCE_PATTERN)}), false)"),
        ("unique_key", "NOT duplicate_key"),
    ]
    return out


def _violations_sql() -> str:
    arms = [f"CASE WHEN NOT coalesce({expr}, false) THEN {_q(rid)} END" for rid, expr in _rules_sql()]
    return f"array_to_string(list_filter([{', '.join(arms)}], lambda v: v IS NOT NULL), ',')"


def _short_season_sql(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{4}}$') THEN substring({c}, 1, 5) || substring({c}, 8, 2) "
            f"WHEN regexp_matches({c}, '^[0-9]{{4}}$') THEN {c} || '-' || lpad(CAST((CAST({c} AS INTEGER) + 1) % 100 AS VARCHAR), 2, '0') "
            f"ELSE {c} END")


BATCH = with_views("player_season", extra={
    "batch0": f"SELECT * REPLACE ({_short_season_sql('season')} AS season), 'tpch' AS source FROM player_season",
    "batch": "SELECT *, count(*) OVER (PARTITION BY player_name, team, season, league) > 1 AS duplicate_key FROM batch0",
    "checked": f"SELECT *, {_violations_sql()} AS violations FROM batch",
})


def _title_sql(x: str) -> str:
    chars = f"string_split({x}, '')"
    body = (f"list_transform({chars}, lambda ch, i: CASE WHEN i = 1 OR lower({chars}[i - 1]) = upper({chars}[i - 1]) "
            f"THEN upper(ch) ELSE lower(ch) END)")
    return f"array_to_string({body}, '')"


@job("v01_v09_validate", BATCH + f"""
SELECT player_id, season, violations, violations = '' AS valid,
       {_title_sql(_collapse_sql('player_name'))} AS normalized_name
FROM checked""")
def v01_v09_validate(spark, sf_dir):
    """V1-V9 in one pass: per row the failed rules, validity and the V1 name form."""
    batch = _batch(spark, sf_dir)
    marked = R.with_violations(R.rule_unique(batch),
                               R.default_rules(CURRENT_YEAR) + [("unique_key", ~F.col("duplicate_key"))])
    return marked.select("player_id", "season", F.array_join("violations", ",").alias("violations"),
                         (F.size("violations") == 0).alias("valid"),
                         R.normalized_player_name().alias("normalized_name"))


@job("v09_violation_counts", BATCH + """
SELECT rule, count(*) AS rows FROM (SELECT unnest(string_split(violations, ',')) AS rule FROM checked WHERE violations <> '') v
GROUP BY rule""")
def v09_violation_counts(spark, sf_dir):
    good, bad = R.validate(_batch(spark, sf_dir), R.default_rules(CURRENT_YEAR))
    return R.violation_counts(bad)


@job("v08_duplicate_keys", with_views("player_season") + """
SELECT player_name, team, league, count(*) AS rows FROM player_season
GROUP BY player_name, team, league HAVING count(*) > 1""")
def v08_duplicate_keys(spark, sf_dir):
    """V8 over (player, team, league) - seasons removed from the key, so repeats exist."""
    ps = TB.player_season(spark, sf_dir)
    flagged = R.rule_unique(ps, ["player_name", "team", "league"])
    return (flagged.where("duplicate_key").groupBy("player_name", "team", "league")
            .agg(F.count(F.lit(1)).alias("rows")))


@job("v10_patch", with_views("player_season") + f"""
SELECT t.player_id, t.player_name, t.team, t.league, t.season, t.season_start_year, t.position,
       t.appearances, coalesce(p.fouls, t.fouls) AS fouls, t.fouls_drawn, t.yellow_cards, t.red_cards, t.minutes,
       CASE WHEN p.player_name IS NOT NULL THEN TIMESTAMP '{PATCH_TS}' END AS updated_at
FROM player_season t LEFT JOIN
     (SELECT player_name, team, season, league, fouls + 1 AS fouls FROM player_season WHERE season = '{PATCH_SEASON}') p
     USING (player_name, team, season, league)""")
def v10_patch(spark, sf_dir):
    """A partial update (fouls only) of one season; other fields keep their value."""
    ps = TB.player_season(spark, sf_dir)
    upd = (ps.where(F.col("season") == PATCH_SEASON)
           .select(*R.KEYS, (F.col("fouls") + 1).alias("fouls"),
                   F.lit(None).cast("string").alias("position")))
    return R.patch(ps, upd, R.KEYS, updated_at=PATCH_TS)
