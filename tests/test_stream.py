"""Layer 4: stream = batch for the request-log operators (file stream, availableNow)."""

import datetime
import shutil
import tempfile

from pyspark.sql import functions as F

from fairplay.sources.tables import requests_log
from fairplay.streaming import live as LV
from fairplay.streaming.admission import sliding_admission, sliding_admission_stream
from tests.conftest import SF_CHECK


def _stream_dir():
    d = tempfile.mkdtemp(prefix="fairplay-stream-")
    shutil.copy(f"{SF_CHECK}/events.parquet", f"{d}/part-0.parquet")
    return d


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_tumbling_counts_stream_equals_batch(spark):
    d = _stream_dir()
    ck = tempfile.mkdtemp(prefix="fairplay-ck-")
    stream = LV.tumbling_counts(LV.read_request_stream(spark, d), "1 hour", "0 seconds")
    LV.run_to_memory(stream, "tumbling_out", ck)
    batch = LV.tumbling_counts(requests_log(spark, SF_CHECK), "1 hour")
    cols = ["window_start", "endpoint", "requests"]
    # append mode emits a window once the watermark passes its end: all but the last
    got = _rows(spark.table("tumbling_out"), cols)
    want = _rows(batch, cols)
    last = max(r[0] for r in want)
    assert got == [r for r in want if r[0] < last]


def test_dedup_within_watermark(spark):
    d = _stream_dir()
    shutil.copy(f"{SF_CHECK}/events.parquet", f"{d}/part-1.parquet")  # replay every request
    ck = tempfile.mkdtemp(prefix="fairplay-ck-")
    LV.run_to_memory(LV.dedup_requests(LV.read_request_stream(spark, d, max_files=1)), "dedup_out", ck)
    assert spark.table("dedup_out").count() == requests_log(spark, SF_CHECK).count()


def _admitted_by_stream(spark, folder, name, limit, window, watermark, max_files=None, schema=None):
    src = LV.read_request_stream(spark, folder, max_files=max_files) if schema is None else (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder))
    stream = sliding_admission_stream(src, limit=limit, window_seconds=window, watermark=watermark)
    LV.run_to_memory(stream, name, tempfile.mkdtemp(prefix="fairplay-ck-"))
    return _rows(spark.table(name), ["event_id", "admitted"])


def test_sliding_admission_stream_equals_batch(spark):
    got = _admitted_by_stream(spark, _stream_dir(), "admission_out", 3, 3600, "0 seconds")
    log = requests_log(spark, SF_CHECK)
    last = log.agg(F.max("ts")).first()[0]
    batch = {r["event_id"]: (r["admitted"], r["ts"]) for r in sliding_admission(log, 3, 3600).collect()}
    assert all(batch[e][0] == a for e, a in got)
    # only requests that the watermark has not passed wait
    assert {e for e, _ in got} >= {e for e, (_, ts) in batch.items() if ts < last - datetime.timedelta(seconds=1)}


def test_sliding_admission_stream_takes_unordered_files_and_long_windows(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, "k" if i % 3 else "j", start + datetime.timedelta(seconds=37 * i)) for i in range(200)]
    schema = "event_id long, client string, ts timestamp"
    shuffled = sorted(rows[:190], key=lambda r: (r[0] // 60, -r[0]))  # backwards inside a file
    for n in range(0, 190, 60):
        spark.createDataFrame(shuffled[n:n + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(999, "z", start + datetime.timedelta(days=9))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = _admitted_by_stream(spark, str(tmp_path / "in"), "admission_long", 2, 3600, "10 days", 1, schema)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batch = sliding_admission(spark.createDataFrame(rows[:190], schema), 2, 3600)
    want = {r["event_id"]: r["admitted"] for r in batch.collect()}
    assert all(want[e] == a for e, a in got)
