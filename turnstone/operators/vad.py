"""Voice activity: runs of scored windows with hysteresis.

A run opens at a window that reaches the threshold and closes once the silence
after it has lasted ``min_silence_ms``; a run that is open at the end of the
recording ends there. Runs are padded on both sides and dropped if, padded, they
are shorter than ``min_speech_ms``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.operators.base import islands, over

WINDOW, SAMPLE_RATE = 512, 16_000


def rechunk(frames: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), window: int = WINDOW) -> DataFrame:
    """Frames (seq, pcm) of any length -> windows ``seq, start_sample, pcm`` of ``window`` samples; what remains at the end is not scored."""
    whole = frames.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "pcm"))), lambda x: x["pcm"])).alias("whole"))
    n = F.size("whole")
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window, F.lit(window)))
    at = whole.select(*keys, "whole", F.posexplode(starts).alias("seq", "start"))
    return at.select(*keys, F.col("seq").cast("bigint").alias("seq"), F.col("start").cast("bigint").alias("start_sample"), F.slice("whole", F.col("start") + 1, F.lit(window)).alias("pcm"))


def voiced_segments(windows: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), threshold: float = 0.5, min_silence_ms: float = 300, min_speech_ms: float = 300, edge_pad_ms: float = 200, sample_rate: int = SAMPLE_RATE, window: int = WINDOW) -> DataFrame:
    """Windows (start_sample, score) -> ``keys, seg_id, t0, t1``."""
    per_ms = sample_rate / 1000
    # the recording's end goes along so that one partitioning serves all
    w = windows.withColumn("total", (F.max("start_sample").over(over(keys)) + window).cast("double"))
    voiced = w.where(F.col("score") >= threshold).withColumn("stop", F.col("start_sample") + window)
    gap = F.col("start_sample") - F.lag("stop").over(over(keys, ["start_sample"]))
    voiced = islands(voiced.withColumn("gap", gap), keys, ["start_sample"], F.col("gap") / per_ms >= min_silence_ms)
    runs = voiced.groupBy(*keys, "island").agg(F.min("start_sample").alias("start"), F.max("stop").alias("stop"), F.max("total").alias("total"))
    still_open = (F.lead("island").over(over(keys, ["island"])).isNull()) & ((F.col("total") - F.col("stop")) / per_ms < min_silence_ms)
    pad = edge_pad_ms / 1000
    runs = runs.withColumn("stop", F.when(still_open, F.col("total")).otherwise(F.col("stop").cast("double")))
    runs = runs.withColumns({"t0": F.greatest(F.lit(0.0), F.col("start") / F.lit(float(sample_rate)) - pad), "t1": F.col("stop") / F.lit(float(sample_rate)) + pad})
    kept = runs.where((F.col("t1") - F.col("t0")) * 1000 >= min_speech_ms)
    return kept.select(*keys, (F.row_number().over(over(keys, ["t0"])) - 1).cast("bigint").alias("seg_id"), "t0", "t1")


def mask_runs(flags: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", flag: str = "voiced", least: int = 1) -> DataFrame:
    """Maximal runs of true flags of ``least`` rows and more: ``keys, first_seq, last_seq, n``."""
    changed = flags.withColumn("_p", F.lag(flag).over(over(keys, [order])))
    runs = islands(changed, keys, [order], ~F.col(flag).eqNullSafe(F.col("_p"))).where(flag)
    return runs.groupBy(*keys, "island").agg(F.min(order).alias("first_seq"), F.max(order).alias("last_seq"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("island")
