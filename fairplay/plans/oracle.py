"""DuckDB twins of the canonical views, for the oracle check.

Each ``oracle_sql()`` text starts with the CTEs it needs, built from the raw
tables by the same rules as ``fairplay.sources.tables``.
"""

from __future__ import annotations

from collections.abc import Iterable

# Fixed mapping of market segment to playing position (fixture rule).
POSITION_CASE = ("CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'GK' WHEN 'MACHINERY' THEN 'DF' "
                 "WHEN 'FURNITURE' THEN 'MF' WHEN 'BUILDING' THEN 'FW' ELSE 'DF,MF' END")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "_li": ((), """
  SELECT l_orderkey,
         CAST(SUM(l_linenumber) AS BIGINT) AS appearances,
         CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS BIGINT) AS fouls,
         CAST(SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS BIGINT) AS fouls_drawn,
         COUNT(*) FILTER (WHERE l_returnflag = 'A') AS yellow_cards,
         COUNT(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS red_cards,
         CAST(SUM(CAST(l_quantity * 15 AS BIGINT)) AS BIGINT) AS minutes_played
  FROM lineitem GROUP BY l_orderkey"""),
    "_players": ((), f"""
  SELECT c_custkey AS player_id, c_name AS player_name, CAST(n_nationkey AS BIGINT) AS team_id,
         n_name AS team, r_name AS league, {POSITION_CASE} AS position
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "player_match": (("_li", "_players"), """
  SELECT p.player_id, p.player_name, o.o_orderkey AS match_id, o.o_orderdate AS match_date,
         CAST(year(o.o_orderdate) AS INTEGER) AS season_start_year,
         p.team_id, p.team, p.league, p.position,
         CASE WHEN o.o_orderkey % 2 = 0 THEN p.team_id ELSE (p.team_id + 1) % 25 END AS home_team_id,
         CASE WHEN o.o_orderkey % 2 = 0 THEN (p.team_id + 1) % 25 ELSE p.team_id END AS away_team_id,
         li.appearances, li.fouls, li.fouls_drawn, li.yellow_cards, li.red_cards, li.minutes_played
  FROM _li li JOIN orders o ON li.l_orderkey = o.o_orderkey
       JOIN _players p ON o.o_custkey = p.player_id"""),
    "player_season": (("_li", "_players"), """
  SELECT p.player_id, p.player_name, p.team, p.league,
         CAST(s.season_start_year AS VARCHAR) || '-' || CAST(s.season_start_year + 1 AS VARCHAR) AS season,
         s.season_start_year, p.position, s.appearances, s.fouls, s.fouls_drawn,
         s.yellow_cards, s.red_cards, s.minutes
  FROM (SELECT o.o_custkey AS player_id, CAST(year(o.o_orderdate) AS INTEGER) AS season_start_year,
               CAST(SUM(li.appearances) AS BIGINT) AS appearances,
               CAST(SUM(li.fouls) AS BIGINT) AS fouls,
               CAST(SUM(li.fouls_drawn) AS BIGINT) AS fouls_drawn,
               CAST(SUM(li.yellow_cards) AS BIGINT) AS yellow_cards,
               CAST(SUM(li.red_cards) AS BIGINT) AS red_cards,
               CAST(SUM(li.minutes_played) AS BIGINT) AS minutes
        FROM _li li JOIN orders o ON li.l_orderkey = o.o_orderkey
        GROUP BY 1, 2) s
  JOIN _players p ON s.player_id = p.player_id"""),
    "requests": ((), """
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id,
         'user:' || CAST(user_id AS VARCHAR) AS client, event_type AS endpoint,
         ['free', 'premium', 'enterprise'][CAST(user_id % 3 AS INTEGER) + 1] AS tier
  FROM events"""),
    "runs": ((), """
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'discipline' AS experiment,
         'run-' || CAST(o_orderkey AS VARCHAR) AS name,
         CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
         CAST(o_orderdate AS TIMESTAMP) AS start_time,
         CASE WHEN o_orderstatus = 'O' THEN NULL
              ELSE CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 7200 AS BIGINT)) END AS end_time
  FROM orders"""),
    "run_metrics": ((), """
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'val_rmse' AS key, o_totalprice / 100000.0 AS value FROM orders
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'val_mae' AS key, o_totalprice / 100000.0 * 0.8 AS value FROM orders"""),
    "model_versions": ((), """
  SELECT model, target, CAST(row_number() OVER (PARTITION BY model, target ORDER BY created, o_orderkey) AS INTEGER) AS version,
         stage, run_id, created, created AS updated
  FROM (SELECT ['xgboost', 'random_forest', 'gradient_boosting'][CAST(o_custkey % 3 AS INTEGER) + 1] AS model,
               ['fouls', 'yellow_cards', 'red_cards'][CAST(floor(o_custkey / 3) % 3 AS INTEGER) + 1] AS target,
               CASE WHEN starts_with(o_orderpriority, '1') THEN 'Production'
                    WHEN starts_with(o_orderpriority, '2') THEN 'Staging'
                    WHEN starts_with(o_orderpriority, '3') THEN 'Archived' ELSE 'None' END AS stage,
               CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_orderdate AS TIMESTAMP) AS created, o_orderkey
        FROM orders) b"""),
}


def _resolve(names: Iterable[str], seen: list[str]) -> None:
    for n in names:
        if n in seen:
            continue
        deps, _ = VIEWS[n]
        _resolve(deps, seen)
        seen.append(n)


def with_views(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause holding the named views (and their dependencies), then ``extra`` CTEs."""
    order: list[str] = []
    _resolve(names, order)
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in order]
    for n, body in (extra or {}).items():
        parts.append(f"{n} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"


def fixed_sql(expr: str, digits: int) -> str:
    """DuckDB twin of ``fairplay.functions.numeric.fixed``."""
    scale = float(10 ** digits)
    x = f"CAST({expr} AS DOUBLE)"
    return (f"CASE WHEN abs({x} * {scale!r}) < {2.0 ** 52!r} THEN CAST(floor({x} * {scale!r} + 0.5) / {scale!r} AS DOUBLE) "
            f"ELSE {x} END")


def normalized(sql: str, doubles: Iterable[str] = ()) -> str:
    """Wrap a query so its DOUBLE columns are rounded like the Spark side."""
    doubles = list(doubles)
    if not doubles:
        return sql
    repl = ", ".join(f"{fixed_sql(c, 6)} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) _q"
