"""Layer 2: literal edge rows (nulls, zero denominators, ties, bin edges, text cases)."""

import math

import pytest
from pyspark.sql import functions as F

from fairplay.functions import text as TX
from fairplay.operators import features as FE
from fairplay.operators import ingest as IN
from fairplay.operators import predict as PR
from fairplay.operators import rules as R
from fairplay.operators.cluster import elbow_k
from fairplay.operators.profiles import player_profile


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_coerce_lenient(spark):
    df = one_col(spark, ["1,234", "12*", "-", "", None])
    got = [r[0] for r in df.select(TX.coerce_num("v")).collect()]
    assert got == [1.234, 12.0, 0.0, 0.0, 0.0]


def test_coerce_strict(spark):
    df = one_col(spark, ["12", "3.9", "x", None])
    assert [r[0] for r in df.select(TX.coerce_int_strict("v")).collect()] == [12, 3, 0, 0]


def test_drop_non_players(spark):
    rows = [("Player", "Squad", "Rk"), ("Squad Total", "X", ""), ("team average", "X", "3"),
            ("Ann Lee", "Alpha", "1"), ("", "Alpha", "2"), ("Bo Ma", "Beta", "x")]
    df = spark.createDataFrame(rows, "player string, team string, rank string")
    out = [r.player for r in IN.drop_non_players(df).collect()]
    assert out == ["Ann Lee"]


def test_dedup_first_in_source_order(spark):
    rows = [("a", "t", 2, 1, 10.0), ("a", "t", 1, 5, 20.0), ("b", "t", 1, 1, 30.0)]
    df = spark.createDataFrame(rows, "player string, team string, page_id long, row_no int, fouls double")
    out = {r.player: r.fouls for r in IN.dedup_first(df, ["player", "team"], ["page_id", "row_no"]).collect()}
    assert out == {"a": 20.0, "b": 30.0}


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 0, "GK")],
                               "appearances long, minutes long, fouls long, fouls_drawn long, "
                               "yellow_cards long, red_cards long, position string")
    r = FE.base_features(df).first()
    assert r.fouls_per_game == 0.0 and r.fouls_per_minute == 0.0 and r.card_to_foul_ratio == 0.0


def test_profile_zero_minutes(spark):
    rows = [(1, 10, "T", "GK", "2020-09-01", 3, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "player_id long, match_id long, team string, position string, "
                                     "match_date string, fouls long, fouls_drawn long, yellow_cards long, "
                                     "red_cards long, minutes_played long").withColumn(
        "match_date", F.to_timestamp("match_date"))
    r = player_profile(df).first()
    assert r.fouls_per_minute == 0.0 and r.fouls_std == 0.0 and r.fouls_early_season == 3.0


def test_average_rank_ties(spark):
    from fairplay.plans.windows import average_rank_table

    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 5.0)], "g int, v double")
    t = average_rank_table(df, ["g"], "v", True, "r")
    got = {r.v: r.r for r in t.collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_right_closed_bins(spark):
    df = one_col(spark, [0, 10, 11, 25, 35, 100, 101], "int")
    b = FE.right_closed_bins("v", FE.EXPERIENCE_EDGES, FE.EXPERIENCE_LABELS)
    assert [r[0] for r in df.select(b).collect()] == [None, "rookie", "developing", "developing",
                                                      "regular", "veteran", None]


def test_single_row_team_std_null(spark):
    df = spark.createDataFrame([("A", "2020-2021", "L", 5, 1, 0, 2, 10, 900, "DF")],
                               "team string, season string, league string, fouls long, yellow_cards long, "
                               "red_cards long, fouls_drawn long, appearances long, minutes long, position string")
    out = FE.team_features(FE.positional_features(FE.base_features(df))).first()
    assert out.team_fouls_std is None and out.team_fouls_mean == 5.0


def test_trend_one_and_two_rows(spark):
    df = spark.createDataFrame([("p", 2020, "t", "l", 1.0), ("p", 2021, "t", "l", 3.0), ("q", 2020, "t", "l", 4.0)],
                               "player_name string, season_start_year int, team string, league string, x double")
    out = FE.rolling_features(df, [3], ["x"]).collect()
    got = {(r.player_name, r.season_start_year): r.x_trend_3 for r in out}
    assert got[("p", 2020)] is None and got[("p", 2021)] == pytest.approx(2.0) and got[("q", 2020)] is None


def test_position_codes(spark):
    df = one_col(spark, [None, "DF,FW", "XX"]).withColumnRenamed("v", "position").withColumn(
        "fouls_per_game", F.lit(1.0))
    rows = FE.positional_features(df).collect()
    assert [r.position_numeric for r in rows] == [2.0, 2.0, 2.0]
    assert (rows[0].is_defender, rows[0].is_versatile) == (0, 0)
    assert (rows[1].is_defender, rows[1].is_forward, rows[1].is_versatile) == (1, 1, 1)
    assert rows[2].is_defender == 0


def _rule_ids(spark, rows, schema, rules):
    df = spark.createDataFrame(rows, schema)
    return [r.violations for r in R.with_violations(df, rules).collect()]


def test_season_rule(spark):
    v = _rule_ids(spark, [("2023-24",), ("1999-00",), ("2023-25",), ("1995-96",)], "season string",
                  R.rule_season(current_year=2026))
    assert v[0] == [] and v[1] == []
    assert "season_consecutive" in v[2]
    assert "season_consecutive" in v[3]


def test_consistency_and_cards(spark):
    schema = ("appearances long, minutes long, fouls long, yellow_cards long, red_cards long")
    v = _rule_ids(spark, [(0, 0, 1, 0, 0), (3, 200, 1, 2, 1)], schema, R.rule_consistency())
    assert v[0] == ["zero_appearance_stats"]
    assert v[1] == ["cards_vs_fouls"]


def test_example_record_valid(spark):
    row = [("Lionel Messi", "Inter Miami", "Premier League", "2023-24", "FW", 30, 25, 60, 3, 0, 2500, "fbref")]
    schema = ("player_name string, team string, league string, season string, position string, "
              "appearances long, fouls long, fouls_drawn long, yellow_cards long, red_cards long, "
              "minutes long, source string")
    good, bad = R.validate(spark.createDataFrame(row, schema), R.default_rules(2026))
    assert good.count() == 1 and bad.count() == 0


def test_entity_decode_in_sequence(spark):
    df = one_col(spark, ["&amp;lt;b&gt;", "<p>x &quot;y&quot;</p>"])
    assert [r[0] for r in df.select(TX.sanitize_html("v")).collect()] == ["&lt;b>", 'x "y"']


def test_title_case_like_python(spark):
    vals = ["o'neil  smith-jones", "ÉMILE zola", "abc1def"]
    df = one_col(spark, vals)
    got = [r[0] for r in df.select(R.normalized_player_name("v")).collect()]
    assert got == [" ".join(v.split()).title() for v in vals]


def test_sanitize_string_like_python(spark):
    vals = ["  a\x00b \t\n c\x01d  ", "x  y", "\x1cq"]
    df = one_col(spark, vals)
    got = [r[0] for r in df.select(TX.sanitize_string("v")).collect()]
    from fairplay.operators.screening import _sanitize_py

    assert got == [_sanitize_py(v) for v in vals]


def test_blocked_patterns_like_python(spark):
    import re

    vals = ["hello", "<script>x</script>", "a onclick = 1", "eval (1)", "DROP table", "../etc",
            "\\x41", "%41", "dropped", "x" * 10001, "selection"]
    df = one_col(spark, vals)
    got = [r[0] for r in df.select(TX.blocked_rules("v")).collect()]
    for v, g in zip(vals, got):
        py = (["too_long"] if len(v) > TX.MAX_STRING_LENGTH else []) + [
            n for n, p in TX.BLOCKED_PATTERNS if re.search(p, v, re.IGNORECASE)]
        assert g == py, v


def test_clean_filename(spark):
    df = one_col(spark, ['..a<b>:c".txt ', "x" * 300 + ".pdf"])
    got = [r[0] for r in df.select(TX.clean_filename("v")).collect()]
    assert got[0] == "abc.txt"
    assert len(got[1]) == 255 and got[1].endswith(".pdf")


def test_elbow():
    assert elbow_k([2, 3, 4, 5], [100, 50, 45, 43]) == 3
    assert elbow_k([2, 3], [10, 5]) == 2


def test_risk_levels(spark):
    df = one_col(spark, [1.0, 1.01, 3.0, 3.01], "double")
    assert [r[0] for r in df.select(PR.risk_level("v", "fouls")).collect()] == [
        "low", "medium", "high", "very_high"]


def test_step_percentile(spark):
    df = one_col(spark, [0.5, 0.51, 3.1], "double")
    assert [r[0] for r in df.select(PR.step_percentile("v", "fouls")).collect()] == [25.0, 50.0, 99.0]


def test_ensemble_skips_missing(spark):
    df = spark.createDataFrame([(1.0, None, 4.0)], "a double, b double, c double")
    e = PR.ensemble({"xgboost": F.col("a"), "random_forest": F.col("b"), "gradient_boosting": F.col("c")})
    assert df.select(e).first()[0] == pytest.approx((0.5 * 1 + 0.2 * 4) / 0.7)


def test_sliding_admission_example(spark):
    from fairplay.streaming.admission import sliding_admission

    rows = [(i, "k", t) for i, t in enumerate([0, 1, 2, 10, 11])]
    df = spark.createDataFrame(rows, "event_id long, client string, t long").withColumn(
        "ts", F.timestamp_seconds("t"))
    out = sliding_admission(df, limit=2, window_seconds=10).orderBy("event_id").collect()
    assert [r.admitted for r in out] == [True, True, False, True, True]
    assert out[2].retry_after == 9.0


def test_empty_upsert_is_noop(spark, tmp_path):
    from fairplay.sources.sinks import upsert_to_path

    path = str(tmp_path / "t")
    df = spark.createDataFrame([("L", "2020", "a", "t", 1)],
                               "league string, season string, player_name string, team string, fouls int")
    df.write.partitionBy("league", "season").parquet(path)
    assert upsert_to_path(spark, path, df.limit(0)) == 0
    assert spark.read.parquet(path).count() == 1


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    from fairplay.sources.sinks import upsert_to_path

    path = str(tmp_path / "t")
    schema = "league string, season string, player_name string, team string, fouls int, scraped_at string"
    spark.createDataFrame([("L", "2020", "a", "t", 1, "old"), ("L", "2021", "b", "t", 2, "old")],
                          schema).write.partitionBy("league", "season").parquet(path)
    upd = spark.createDataFrame([("L", "2020", "a", "t", 9, "new"), ("L", "2020", "c", "t", 3, "new")], schema)
    n = upsert_to_path(spark, path, upd, keep_cols=["scraped_at"])
    got = {(r.season, r.player_name): (r.fouls, r.scraped_at)
           for r in spark.read.schema(schema).parquet(path).collect()}
    assert n == 2
    assert got == {("2020", "a"): (9, "old"), ("2020", "c"): (3, "new"), ("2021", "b"): (2, "old")}


def test_patch_only_supplied_fields(spark):
    t = spark.createDataFrame([("a", 1, 5)], "k string, fouls int, red int")
    p = spark.createDataFrame([("a", None, 7)], "k string, fouls int, red int")
    r = R.patch(t, p, ["k"], updated_at="2024-01-01 00:00:00").first()
    assert (r.fouls, r.red) == (1, 7) and r.updated_at is not None


def test_json_limits_and_sanitize(spark):
    from fairplay.operators.screening import audit_json

    deep = "{" + '"a": {' * 11 + "}" * 12
    rows = [(1, '{"k": 1}'), (2, deep), (3, '{"k": " x\\u0000  y "}'), (4, "not json"), (5, '{"k": true}')]
    df = spark.createDataFrame(rows, "id long, doc string")
    out = {r.id: r for r in audit_json(df, "id", "doc", ["k"], {"k": "integer"}).collect()}
    assert out[1].limits.max_depth == 1 and out[1].limits.violations == [] and out[1].schema_ok
    assert "too_deep" in out[2].limits.violations and not out[2].schema_ok
    assert out[3].sanitized == '{"k": "x y"}' and not out[3].schema_ok
    assert out[4].limits.violations == ["invalid_json"] and out[4].schema_ok is False
    assert out[5].schema_ok
