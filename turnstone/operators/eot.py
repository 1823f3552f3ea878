"""End of turn: holding back segments that seem to stop in mid-thought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators.base import ordered_rows

MAX_MERGE_S, MIN_INCOMPLETE_MS = 4.0, 800.0


def verdict(answer: Column, text: Column) -> Column:
    """Is the turn complete? "yes" within the answer's first ten characters and no "no" before its end; blank text and a failed model (null) count as complete."""
    head = F.substring(F.lower(F.trim(answer)), 1, 10)
    yes = F.locate("yes", head)
    said = (yes > 0) & (F.locate("no", F.substring(head, F.lit(1), yes + 2)) == 0)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(True)).otherwise(F.coalesce(said, F.lit(True)))


def merge_turns(segments: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", max_merge_s: float = MAX_MERGE_S, min_incomplete_ms: float = MIN_INCOMPLETE_MS) -> DataFrame:
    """Segments (seq, t0, t1, complete) -> ``keys, first_seq, last_seq, t0, t1``.

    A long enough segment with nothing pending passes; else it is joined to what
    is pending, and goes out once long or complete. The end lets go of the rest.
    """

    def fold(part: dict[str, list]) -> list[tuple]:
        key, out, held = tuple(part[k][0] for k in keys), [], None
        for seq, t0, t1, complete in zip(part[order], part["t0"], part["t1"], part["complete"], strict=True):
            if held is None and (t1 - t0) * 1000 >= min_incomplete_ms:
                out.append((*key, seq, seq, t0, t1))
                continue
            held = (seq, seq, t0, t1) if held is None else (held[0], seq, held[2], t1)
            if held[3] - held[2] >= max_merge_s or complete:
                out.append((*key, *held))
                held = None
        return out if held is None else [*out, (*key, *held)]

    kinds = ", ".join(f"{k} {segments.schema[k].dataType.simpleString()}" for k in keys)
    times = [F.col(t).cast("double").alias(t) for t in ("t0", "t1")]
    return ordered_rows(segments.select(*keys, order, *times, "complete"), keys, [order], fold, f"{kinds}, first_seq bigint, last_seq bigint, t0 double, t1 double")


def joined_sound(a: Column, b: Column, gap_s: Column, sample_rate: int) -> Column:
    """Samples of two segments with silence for the gap between them (none where they overlap)."""
    gap = F.greatest(F.lit(0), F.rint(gap_s * sample_rate).cast("int"))
    return F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), gap), b)


def false_cuts(texts: DataFrame, *, keys: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """``n, n_empty, n_false, rate``: texts that end without ``. ? !``, over those that aren't empty."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[ \t\r\n]+$", ""), "^[ \t\r\n]+", "")
    marked = texts.withColumn("_t", t)
    cut = (F.col("_t") != "") & ~F.right("_t", F.lit(1)).isin(".", "?", "!")
    out = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_t") == "").alias("n_empty"), F.count_if(cut).alias("n_false"))
    return out.withColumn("rate", F.col("n_false") / F.greatest(F.lit(1), F.col("n") - F.col("n_empty")))
