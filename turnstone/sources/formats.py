"""Readers of text formats: RTTM, diarizer lines, captions, manifests, recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators.base import upto


def _fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, "[ \t\r\n]+", " ")), " ")


def rttm_words(lines: DataFrame, line_col: str = "line", least_fields: int = 10) -> DataFrame:
    """``start, end, speaker, word`` of SPEAKER lines with enough fields; other columns stay."""
    f = lines.withColumn("_f", _fields(F.col(line_col))).where((F.size("_f") >= least_fields) & (F.col("_f")[0] == "SPEAKER"))
    start, dur = F.col("_f")[3].try_cast("double"), F.col("_f")[4].try_cast("double")
    return f.withColumns({"start": start, "end": start + dur, "speaker": F.col("_f")[7], "word": F.element_at("_f", -1)}).where("end IS NOT NULL").drop("_f", line_col)


def rttm_turns(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """As ``rttm_words`` for turns, which have eight fields and no word."""
    return rttm_words(lines, line_col, 8).drop("word")


def diarizer_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``start, end, speaker``: "start end speaker" with end after start, or a SPEAKER line of eight fields; all else is skipped."""
    f = lines.withColumn("_f", _fields(F.col(line_col)))
    tagged = (F.size("_f") >= 8) & (F.col("_f")[0] == "SPEAKER")
    a = F.when(tagged, F.col("_f")[3]).when(F.size("_f") == 3, F.col("_f")[0]).try_cast("double")
    b = F.when(tagged, F.col("_f")[4]).when(F.size("_f") == 3, F.col("_f")[1]).try_cast("double")
    end = F.when(tagged, a + b).otherwise(b)
    out = f.withColumns({"start": a, "end": end, "speaker": F.when(tagged, F.col("_f")[7]).otherwise(F.col("_f")[2]), "_t": tagged})
    return out.where("start IS NOT NULL AND end IS NOT NULL AND (_t OR end > start)").drop("_f", "_t", line_col)


_CUE = r"[0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{3}[ \t]*-->[ \t]*([0-9]{2}):([0-9]{2}):([0-9]{2})"


def caption_text(lines: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: tuple[str, ...] = ("line_no",), line_col: str = "line", max_s: float | None = None) -> DataFrame:
    """WebVTT lines -> one text a recording. The first cue that ends after ``max_s`` ends the text for good."""
    line = F.trim(F.col(line_col))
    cue = line.rlike(_CUE)
    end = sum(F.regexp_extract(line, _CUE, k + 1).try_cast("int") * unit for k, unit in enumerate((3600, 60, 1)))
    late = (cue & (end > F.lit(max_s))) if max_s is not None else F.lit(False)
    spoken = (line != "") & ~line.rlike("^(WEBVTT|NOTE|STYLE|REGION)") & ~cue
    marked = lines.withColumns({"_s": spoken, "_c": F.max(late.cast("int")).over(upto(keys, order)), "_t": F.regexp_replace(line, "<[^>]+>", ""), "_o": F.struct(*order)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_s") & (F.col("_c") == 0), F.struct("_o", "_t")))), lambda x: x["_t"]), " ")
    return marked.groupBy(*keys).agg(text.alias("text"))


def manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Clips of a JSON manifest, ``{"clips": [{clip_id, wav, ...}]}``, by id."""
    clips = spark.read.option("multiLine", True).json(path).select(F.explode("clips").alias("c")).select("c.*").orderBy("clip_id")
    return clips if limit is None else clips.limit(limit)


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files (path, content) whose content has the SHA-256 that ``expected`` (path, sha256) names."""
    return files.join(expected, "path").where(F.sha2("content", 256) == F.lower("sha256")).drop("sha256")


_WAV = "rec_id string, sample_rate int, channels int, pcm array<float>, error string"


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """PCM16 WAV files as mono recordings; what can't be decoded has an ``error`` and no sound."""
    import io
    import wave
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        if w.getsampwidth() != 2:
                            raise ValueError("16-bit PCM only")
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
                        rows.append((path, w.getframerate(), w.getnchannels(), (x.mean(1) / 32768).astype(np.float32), None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((path, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["rec_id", "sample_rate", "channels", "pcm", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, _WAV)
