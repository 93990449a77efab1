"""Benchmark: run the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line at the end: {"metric", "value" (sum of per-query seconds), "unit",
"queries" {name: sec}, "rows_out", "sf", "not_run", ...}; every job also reports to stderr
as it ends. A job is built and run once at the smallest scale factor beside $BENCH_SF_DIR,
which compiles its code, and is then timed: built once, written to the no-op sink (every
row computed, nothing collected), rows counted on the way ($BENCH_RUNS runs, median). No
job is begun after $BENCH_BUDGET seconds (1500), and a SIGTERM ends the run; the line
then holds what was measured and names the rest.
"""

from __future__ import annotations

import glob
import json
import os
import re
import signal
import statistics
import sys
import time

HEADLINE = [
    "q1_list_players", "q3_team_fouls_summary_all", "q7_record_ratios", "q12_top_players",
    "q16_rank_teams", "q21_trailing_period", "q24_min_games", "f18_f19_rolling_features",
    "f22_feature_scores", "f27_lookback_features", "p01_p08_player_profile",
    "k07_cluster_metrics", "k10_top_features", "a05_deviations", "m08_m11_regression_metrics",
    "m20_player_risk", "s1_c7_ingest_roundtrip", "s4_upsert_merge", "c08_sanitize_string",
    "c13_screen_text", "v01_v09_validate", "t02_best_version", "r02_sliding_log",
    "r03_sliding_admission", "k01_kmeans", "k03_dbscan", "k13_pca_projection", "a01_isolation_forest",
    "a02_kernel_novelty", "m04_m05_linear", "m02_random_forest",
]


def small_dir(sf_dir: str) -> str:
    """The smallest scale factor beside ``sf_dir``."""
    beside = [p for p in glob.glob(os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf*")) if re.search(r"sf[0-9.]+$", p)]
    return min(beside, key=lambda p: float(p.rpartition("sf")[2]), default=sf_dir)


def measured(spark, build, sf_dir: str) -> tuple[float, int]:
    """(seconds, rows) of one build and full execution."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    t0 = time.perf_counter()
    seen = Observation()
    build(spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0, int(seen.get["n"])


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    budget = float(os.environ.get("BENCH_BUDGET", "1500"))
    names = sys.argv[1:] or HEADLINE
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [here, os.environ.get("PYTHONPATH")]))  # for the workers
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    failed: dict[str, str] = {}
    began = time.perf_counter()

    def report() -> None:
        m = re.search(r"sf([0-9.]+)", sf_dir)
        print(json.dumps({
            "metric": "headline_jobs_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "rows_out": rows, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus), "runs": runs,
            "failed": failed,
            "not_run": [n for n in names if n not in times and n not in failed]}), flush=True)

    def ended(*_) -> None:
        report()
        os._exit(0)

    signal.signal(signal.SIGTERM, ended)
    from fairplay.plans.catalog import load_all
    from fairplay.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(2 * int(cpus), 8), app="fairplay-bench")
    catalog = load_all()
    for name in names:
        if time.perf_counter() - began > budget:
            break
        try:
            measured(spark, catalog[name].build, small_dir(sf_dir))
            samples = [measured(spark, catalog[name].build, sf_dir) for _ in range(runs)]
        except Exception as e:  # told in the line; the other jobs still count
            failed[name] = repr(e)[:200]
            continue
        times[name], rows[name] = round(statistics.median(t for t, _ in samples), 3), samples[0][1]
        print(f"{name}: {times[name]} s, {rows[name]} rows", file=sys.stderr, flush=True)
    report()
    return 0


if __name__ == "__main__":
    sys.exit(main())
