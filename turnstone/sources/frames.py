"""Frames of sound: framing of arrays, the contract of streams, clips, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators.base import preceding, upto

SAMPLE_RATE, FRAME_MS = 16_000, 20


def array_frames(recordings: DataFrame, *, pcm_col: str = "pcm", keys: tuple[str, ...] = ("rec_id",), sample_rate: int = SAMPLE_RATE, frame_ms: int = FRAME_MS) -> DataFrame:
    """``keys, seq, t0, sample_rate, pcm``: blocks of equal length, the last one padded with zeros; an empty array has none."""
    size = sample_rate * frame_ms // 1000
    if size <= 0:
        raise ValueError("a frame must hold a sample")
    n = F.size(pcm_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    at = recordings.select(*keys, F.col(pcm_col).alias("whole"), F.posexplode(starts).alias("seq", "start"))
    part = F.slice("whole", F.col("start") + 1, F.lit(size))
    padded = F.concat(part, F.array_repeat(F.lit(0.0).cast("float"), F.lit(size) - F.size(part)))
    return at.select(*keys, F.col("seq").cast("bigint").alias("seq"), (F.col("start") / F.lit(float(sample_rate))).alias("t0"), F.lit(sample_rate).alias("sample_rate"), padded.alias("pcm"))


def contract_violation(sample_rate: Column, channels: Column, n_samples: Column, dtype: Column, *, expected_rate: int = SAMPLE_RATE, frame_ms: int = FRAME_MS) -> Column:
    """What a streamed frame breaks, or null; a short tail is allowed."""
    longest = expected_rate * frame_ms // 1000
    return (
        F.when(dtype != "float32", F.concat(F.lit("frames must be float32, got "), dtype))
        .when(channels != 1, F.lit("frames must be mono"))
        .when(sample_rate != expected_rate, F.concat(F.lit("rate must be "), F.lit(str(expected_rate))))
        .when(n_samples > longest, F.concat(F.lit("frames must have at most "), F.lit(str(longest)), F.lit(" samples")))
    )


def enforce_contract(frames: DataFrame, violation: Column) -> DataFrame:
    """``frames``; a row that breaks the contract fails the query."""
    return frames.withColumn("_ok", F.when(violation.isNotNull(), F.raise_error(violation)).otherwise(F.lit(True))).where("_ok").drop("_ok")


def positive_duration(value: Column) -> Column:
    """Probed duration; null where it can't be read or isn't positive."""
    d = value.try_cast("double")
    return F.when(d > 0, d)


def clip(frames: DataFrame, max_s: float, *, keys: tuple[str, ...] = ("rec_id",), order: tuple[str, ...] = ("seq",), duration_col: str = "dur") -> DataFrame:
    """Frames of each recording up to and with the one that crosses ``max_s`` of sound."""
    return frames.withColumn("_before", F.coalesce(F.sum(duration_col).over(preceding(keys, order)), F.lit(0.0))).where(F.col("_before") < max_s).drop("_before")


def rebased(frames: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: tuple[str, ...] = ("seq",), clock: str = "wall") -> DataFrame:
    """Live frames with ``t0``: their clock since the recording's first frame."""
    return frames.withColumn("t0", F.col(clock) - F.first(clock).over(upto(keys, order)))
