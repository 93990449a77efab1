"""Data-quality rules as Boolean column expressions, evaluated in one pass.

A rule is (id, expression that is TRUE when the row passes). ``validate``
builds the violations array with every rule in a single projection, splits
good/bad rows, and counts violations per rule with explode + groupBy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairplay.functions.text import collapse_ws, title_case

# Fixed values (must equal the reference's for equal results).
NAME_PATTERN = "^[a-zA-ZÀ-ÿ\\s\\-']+$"
POSITIONS = ["GK", "DF", "MF", "FW", "DF,MF", "MF,FW", "DF,FW"]
LEAGUES = ["Premier League", "La Liga", "Bundesliga", "Serie A", "Ligue 1", "Champions League",
           "Europa League", "Brasileirão"]
RANGES = {"appearances": (0, 100), "fouls": (0, 500), "fouls_drawn": (0, 500),
          "yellow_cards": (0, 50), "red_cards": (0, 10), "minutes": (0, 10000)}
SOURCE_PATTERN = "^[a-zA-Z0-9_-]+$"
SEASON_PATTERN = "^[0-9]{4}-[0-9]{2}$"
KEYS = ["player_name", "team", "season", "league"]

Rule = tuple[str, Column]


def _not_blank(c: Column) -> Column:
    return c.isNotNull() & (F.length(collapse_ws(c)) > 0)


def rule_player_name(col: str = "player_name") -> list[Rule]:
    """V1: 2..255 chars, not blank, letters (ASCII + U+00C0..U+00FF), space, '-', "'"."""
    c = F.col(col)
    return [("player_name_length", F.length(c).between(2, 255)),
            ("player_name_blank", _not_blank(c)),
            ("player_name_chars", F.coalesce(collapse_ws(c).rlike(NAME_PATTERN), F.lit(False)))]


def normalized_player_name(col: str = "player_name") -> Column:
    """V1 output form: whitespace collapsed, Python-style title case."""
    return title_case(collapse_ws(F.col(col)))


def rule_text(col: str, lo: int = 2, hi: int = 255) -> list[Rule]:
    """V2: length lo..hi and not blank."""
    c = F.col(col)
    return [(f"{col}_length", F.coalesce(F.length(c).between(lo, hi), F.lit(False))),
            (f"{col}_blank", _not_blank(c))]


def season_short(col: str = "season") -> Column:
    """Ingest season 'YYYY-YYYY' or 'YYYY' -> validation form 'YYYY-YY'."""
    c = F.col(col)
    return (F.when(c.rlike("^[0-9]{4}-[0-9]{4}$"),
                   F.concat(F.substring(c, 1, 5), F.substring(c, 8, 2)))
            .when(c.rlike("^[0-9]{4}$"),
                  F.concat(c, F.lit("-"),
                           F.lpad(F.pmod(c.cast("int") + 1, F.lit(100)).cast("string"), 2, "0")))
            .otherwise(c))


def rule_season(col: str = "season", current_year: int | None = None) -> list[Rule]:
    """V3: YYYY-YY, end (read as 20YY) = start + 1, 1990 <= start <= current_year + 1
    (without a year: that of the query's date)."""
    c = F.col(col)
    year = F.year(F.current_date()) if current_year is None else F.lit(current_year)
    fmt = F.coalesce(c.rlike(SEASON_PATTERN), F.lit(False))
    start = F.substring(c, 1, 4).try_cast("int")
    end = F.lit(2000) + F.substring(c, 6, 2).try_cast("int")
    return [("season_format", fmt),
            ("season_consecutive", F.when(fmt, end == start + 1).otherwise(F.lit(False))),
            ("season_range", F.when(fmt, start.between(F.lit(1990), year + 1)).otherwise(F.lit(False)))]


def rule_range(ranges: dict[str, tuple[int, int]] = RANGES) -> list[Rule]:
    """V4: lo <= value <= hi (a missing counter counts as 0)."""
    return [(f"{c}_range", F.coalesce(F.col(c), F.lit(0)).between(lo, hi))
            for c, (lo, hi) in ranges.items()]


def rule_ratio() -> list[Rule]:
    """V5: per-appearance caps (only when appearances > 0); red <= appearances."""
    app = F.coalesce(F.col("appearances"), F.lit(0))

    def capped(c: str, k: int) -> Column:
        return (app <= 0) | (F.coalesce(F.col(c), F.lit(0)) <= app * k)

    return [("fouls_per_game_cap", capped("fouls", 20)),
            ("yellow_per_game_cap", capped("yellow_cards", 3)),
            ("minutes_per_game_cap", capped("minutes", 120)),
            ("red_le_appearances", F.coalesce(F.col("red_cards"), F.lit(0)) <= app)]


def rule_consistency() -> list[Rule]:
    """V6: zero appearances -> zero minutes/fouls/cards; cards <= 2 x fouls when fouls > 0."""
    def z(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    app = z("appearances")
    cards = z("yellow_cards") + z("red_cards")
    fouls = z("fouls")
    return [("zero_appearance_stats",
             (app != 0) | ((z("minutes") <= 0) & (fouls <= 0) & (z("yellow_cards") <= 0)
                           & (z("red_cards") <= 0))),
            ("cards_vs_fouls", ~((cards > fouls) & (fouls > 0) & (cards > fouls * 2)))]


def rule_in_set(col: str, values: Sequence[str], rule_id: str | None = None,
                nullable: bool = True) -> list[Rule]:
    """V7: value in a code list (null allowed when nullable)."""
    c = F.col(col)
    ok = c.isin(list(values))
    ok = (c.isNull() | ok) if nullable else F.coalesce(ok, F.lit(False))
    return [(rule_id or f"{col}_code", ok)]


def rule_source(col: str = "source") -> list[Rule]:
    return [("source_id", F.coalesce(F.col(col).rlike(SOURCE_PATTERN), F.lit(False)))]


def default_rules(current_year: int | None = None) -> list[Rule]:
    return (rule_player_name() + rule_text("team") + rule_text("league", 2, 100)
            + rule_season(current_year=current_year) + rule_range() + rule_ratio()
            + rule_consistency() + rule_in_set("position", POSITIONS) + rule_source())


def with_violations(df: DataFrame, rules: Sequence[Rule], name: str = "violations") -> DataFrame:
    """V9: one projection adds ARRAY<STRING> of failed rule ids (a null test fails)."""
    checks = [F.when(~F.coalesce(expr, F.lit(False)), F.lit(rid)) for rid, expr in rules]
    return df.withColumn(name, F.filter(F.array(*checks), lambda v: v.isNotNull()))


def rule_unique(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "duplicate_key") -> DataFrame:
    """V8: flag rows whose key occurs more than once in the batch.

    Counts per key are a hash aggregate (partial counts per task, so a key
    repeated across a third of the batch is reduced before the shuffle) and
    only the repeated keys are joined back; a null key never matches, as in
    a unique index.
    """
    dup = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
           .select(*keys, F.lit(True).alias(name)))
    cond = [df[k] == dup[k] for k in keys]
    out = df.join(dup, cond, "left").select(df["*"], F.coalesce(dup[name], F.lit(False)).alias(name))
    return out


def validate(df: DataFrame, rules: Sequence[Rule] | None = None,
             keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """V9: (good, bad) split; bad rows carry their violation list."""
    rules = list(rules) if rules is not None else default_rules()
    marked = rule_unique(df, keys)
    marked = with_violations(marked, rules + [("unique_key", ~F.col("duplicate_key"))])
    good = marked.where(F.size("violations") == 0).drop("violations", "duplicate_key")
    bad = marked.where(F.size("violations") > 0).drop("duplicate_key")
    return good, bad


def violation_counts(bad: DataFrame) -> DataFrame:
    """Counts of each violated rule (explode + group)."""
    return (bad.select(F.explode("violations").alias("rule"))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("rows")))


def patch(target: DataFrame, patch_df: DataFrame, keys: Sequence[str],
          updated_at: str | None = None) -> DataFrame:
    """Only supplied (non-null) fields change; ``updated_at`` set on patched rows."""
    fields = [c for c in patch_df.columns if c not in keys and c in target.columns]
    p = patch_df.select(*keys, *[F.col(c).alias(f"__p_{c}") for c in fields],
                        F.lit(True).alias("__patched"))
    joined = target.join(p, list(keys), "left")
    cols = {c: F.coalesce(F.col(f"__p_{c}"), F.col(c)) for c in fields}
    ts = F.to_timestamp(F.lit(updated_at)) if updated_at else F.current_timestamp()
    if "updated_at" in target.columns:
        cols["updated_at"] = F.when(F.col("__patched"), ts).otherwise(F.col("updated_at"))
    else:
        cols["updated_at"] = F.when(F.col("__patched"), ts)
    out = joined.withColumns(cols)
    return out.drop(*[f"__p_{c}" for c in fields], "__patched")
