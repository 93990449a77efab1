"""Layer 5: plan checks - pushdown, pruning, no cartesian products, broadcast only when small."""

import pytest
from pyspark.sql import functions as F

from fairplay.plans.catalog import load_all
from tests.conftest import SF_SMALL

PLAN_JOBS = ["q1_list_players", "q3_team_fouls_summary", "f18_f19_rolling_features",
             "p01_p08_player_profile", "k07_cluster_metrics", "m20_player_risk", "r02_sliding_log",
             "s4_upsert_merge", "t05_retain_kept", "c13_screen_text", "s1_c7_ingest_roundtrip"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAN_JOBS)
def test_no_cartesian_product(spark, name):
    p = plan(load_all()[name].build(spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_and_columns_reach_the_scan(spark):
    from fairplay.sources.tables import read_table

    li = read_table(spark, SF_SMALL, "lineitem").where(F.col("l_discount") > 0.05).select("l_orderkey")
    p = li._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_discount), GreaterThan(l_discount,0.05)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double>" in p


def test_lineitem_aggregated_before_join(spark):
    from fairplay.sources.tables import player_match

    p = plan(player_match(spark, SF_SMALL))
    assert "HashAggregate" in p and "partial_sum" in p


def test_bounded_broadcast_only_for_small_sides(spark):
    from fairplay.plans.joins import bounded_broadcast, estimated_bytes
    from fairplay.sources.tables import read_table

    small = read_table(spark, SF_SMALL, "nation")
    big = spark.range(10 ** 9)
    assert estimated_bytes(small) < 10 ** 6
    assert "broadcast" in bounded_broadcast(small)._jdf.queryExecution().logical().toString().lower()
    assert bounded_broadcast(big, 10 ** 6) is big
