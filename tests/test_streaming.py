"""Streams give what batches give, whatever the cut into micro-batches and the order within."""

import time

import numpy as np
import pytest

from turnstone.operators import diarize, eot, summary, vad
from turnstone.streaming import processors


def streamed(spark, tmp_path, df, plan, batches=3):
    rows = df.collect()
    folder = tmp_path / "in"
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"t{abs(hash(str(tmp_path)))}"
    q = plan(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return spark.table(name)


def ends(rows, n):
    return [(*r, k % n == n - 1) for k, r in enumerate(rows)]


def test_voice(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(rec, k, k * 512, float(v)) for rec in ("a", "b") for k, v in enumerate(np.repeat(rng.random(12) > 0.5, rng.integers(1, 25, 12))[:100])]
    counts = {rec: sum(r[0] == rec for r in rows) for rec in ("a", "b")}
    rows = [(*r, r[1] == counts[r[0]] - 1) for r in rows]
    df = spark.createDataFrame(rows, "rec_id string, seq bigint, start_sample bigint, score double, is_last boolean")
    got = streamed(spark, tmp_path, df, lambda s: processors.voiced_segments(s, idle_ms=None))
    assert sorted(got.collect()) == sorted(vad.voiced_segments(df).collect()) and got.count()


def test_clusters(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = np.eye(8)[rng.integers(0, 4, 40)] + rng.normal(0, 0.05, (40, 8))
    df = spark.createDataFrame(ends([("a", k, k * 1.0, k + 0.6, v.tolist()) for k, v in enumerate(x)], 40), "rec_id string, seq bigint, t0 double, t1 double, embedding array<double>, is_last boolean")
    got = streamed(spark, tmp_path, df, lambda s: processors.online_cluster(s, idle_ms=None))
    assert sorted(got.collect()) == sorted(diarize.online_cluster(df).collect())


def test_turns(spark, tmp_path):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame(ends([("a", k, k * 2.0, k * 2.0 + float(rng.random()), bool(rng.random() > 0.6)) for k in range(30)], 30), "rec_id string, seq bigint, t0 double, t1 double, complete boolean, is_last boolean")
    got = streamed(spark, tmp_path, df, lambda s: processors.merge_turns(s, idle_ms=None))
    assert sorted(got.collect()) == sorted(eot.merge_turns(df).collect())


@pytest.mark.parametrize("flush_s", [10.0, None])
def test_summaries(spark, tmp_path, flush_s):
    df = spark.createDataFrame(ends([("a", k, k * 2.0, k * 2.0 + 1, "S0", f"word {k} and more") for k in range(20)], 20), "rec_id string, seq bigint, t0 double, t1 double, speaker string, text string, is_last boolean")
    got = streamed(spark, tmp_path, df, lambda s: processors.summaries(s, recent_s=5.0, flush_s=flush_s, idle_ms=None))
    want = summary.snapshots(df, recent_s=5.0, flush_s=flush_s).drop("seq")
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_lost_row_stalls_no_recording(spark, tmp_path):
    """Row 2 never comes and nothing says that the recording has ended; silence lets go of what waits behind."""
    df = spark.createDataFrame([("a", k, k * 2.0, k * 2.0 + 1, True, False) for k in range(6) if k != 2], "rec_id string, seq bigint, t0 double, t1 double, complete boolean, is_last boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = processors.merge_turns(source, idle_ms=1000).writeStream.format("memory").queryName("lost_row").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("lost_row").count() < 5:
            time.sleep(1)
        assert sorted(r.first_seq for r in spark.table("lost_row").collect()) == [0, 1, 3, 4, 5]
    finally:
        q.stop()
