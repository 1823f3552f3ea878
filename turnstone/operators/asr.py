"""Packing segments for transcription, and giving phrases back to segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators.base import ordered_rows, over, preceding

MAX_CHUNK_S, PAD_S, MIN_SEGMENT_MS = 24.0, 0.1, 250.0


def packed(durations: list[float], max_s: float = MAX_CHUNK_S, pad_s: float = PAD_S, breaks: list[bool] | None = None) -> list[int]:
    """Chunk of each item: a new one begins when the next item and its pad don't fit, or where ``breaks`` says so; an item that is too long is alone."""
    chunk, filled, out = 0, 0.0, []
    for k, d in enumerate(durations):
        if filled and (filled + pad_s + d > max_s or breaks and breaks[k]):
            chunk, filled = chunk + 1, 0.0
        filled += (pad_s if filled else 0.0) + d
        out.append(chunk)
    return out


def pack(segments: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", duration: str = "dur", max_s: float = MAX_CHUNK_S, pad_s: float = PAD_S, speaker: str | None = None) -> DataFrame:
    """``keys, seq, dur, chunk``; with ``speaker`` a chunk holds one speaker's segments only."""

    def fold(part: dict[str, list]) -> list[tuple]:
        who = part[speaker] if speaker else []
        breaks = [k == 0 or who[k] != who[k - 1] for k in range(len(who))] if speaker else None
        return list(zip(*[part[k] for k in keys], part[order], part[duration], packed(part[duration], max_s, pad_s, breaks), strict=True))

    kinds = ", ".join(f"{c} {segments.schema[c].dataType.simpleString()}" for c in (*keys, order))
    return ordered_rows(segments.select(*keys, order, F.col(duration).cast("double").alias(duration), *([speaker] if speaker else [])), keys, [order], fold, f"{kinds}, {duration} double, chunk int")


def local_windows(chunks: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", duration: str = "dur", pad_s: float = PAD_S) -> DataFrame:
    """``lo, hi``: where each segment lies within its chunk, pads between."""
    lo = F.coalesce(F.sum(F.col(duration) + pad_s).over(preceding([*keys, "chunk"], [order])), F.lit(0.0))
    return chunks.withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col(duration))


def assign_phrases(phrases: DataFrame, windows: DataFrame, *, keys: tuple[str, ...] = ("rec_id", "chunk"), phrase: str = "phrase_id", order: str = "seq") -> DataFrame:
    """Each phrase (local t0, t1) with the segment ``seq`` whose window its midpoint is in, the first of them, else the nearest edge's; ``at0, at1`` are its times in the recording."""
    mid = (F.col("t0") + F.col("t1")) / 2
    joined = phrases.join(windows.select(*keys, order, "lo", "hi", "seg_t0"), [*keys]).withColumn("_m", mid)
    inside = (F.col("_m") >= F.col("lo")) & (F.col("_m") <= F.col("hi"))
    far = F.when(inside, F.lit(-1.0)).otherwise(F.least(F.abs(F.col("_m") - F.col("lo")), F.abs(F.col("_m") - F.col("hi"))))
    first = joined.withColumn("_r", F.row_number().over(over([*keys, phrase], [far, order]))).where("_r = 1")
    at = lambda t: F.col("seg_t0") + F.greatest(F.lit(0.0), F.col(t) - F.col("lo"))
    return first.withColumns({"at0": at("t0"), "at1": at("t1")}).drop("_r", "_m", "lo", "hi", "seg_t0")


def utterances(segments: DataFrame, phrases: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", phrase: str = "phrase_id") -> DataFrame:
    """One row for every segment, phrases or not: ``text``, ``words`` and the first ``language`` that isn't empty."""
    t = F.trim("text")
    rows = phrases.select(*keys, order, F.struct(F.col(phrase).alias("p"), F.col("at0").alias("t0"), F.col("at1").alias("t1"), t.alias("text"), F.nullif("language", F.lit("")).alias("language")).alias("w"))
    listed = rows.groupBy(*keys, order).agg(F.array_sort(F.collect_list("w")).alias("w"))
    said = F.filter("w", lambda x: x["text"] != "")
    out = listed.select(*keys, order, F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("text"), F.transform(said, lambda x: F.struct(x["t0"].alias("t0"), x["t1"].alias("t1"), x["text"].alias("text"))).alias("words"), F.get(F.filter(F.transform("w", lambda x: x["language"]), lambda x: x.isNotNull()), F.lit(0)).alias("language"))
    full = segments.join(out, [*keys, order], "left")
    return full.withColumns({"text": F.coalesce("text", F.lit("")), "words": F.coalesce("words", F.array().cast("array<struct<t0:double,t1:double,text:string>>"))})


def gated(t0: Column, t1: Column, text: Column, min_segment_ms: float = MIN_SEGMENT_MS) -> Column:
    """Text of a segment transcribed alone: empty where it is too short; null, a row to drop, where the model failed."""
    return F.when((t1 - t0) * 1000 < min_segment_ms, F.lit("")).otherwise(text)


def transcribe(chunks: DataFrame, load: Callable[[], Callable[[object], str]], *, pcm: str = "pcm", out: str = "text") -> DataFrame:
    """The model seam: ``load()`` gives a worker its model, once; a call that fails gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(x: object) -> str | None:
            try:
                return model(x)
            except Exception:  # noqa: BLE001  a model's failure is a null
                return None

        for batch in batches:
            yield batch.assign(**{out: [one(x) for x in batch[pcm]]}).drop(columns=[pcm])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != pcm)
    return chunks.mapInPandas(run, f"{kinds}, {out} string")
