"""What events look like on their way out."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions.columns import fixed
from turnstone.operators.base import over

log = logging.getLogger(__name__)


def jsonl(events: DataFrame, name: str = "value") -> DataFrame:
    """One JSON object a row, without sound."""
    return events.select(F.to_json(F.struct(*[F.col(c) for c in events.columns if c != "pcm"])).alias(name))


def human_line(t0: Column, t1: Column, speaker: Column, text: Column) -> Column:
    """``[  12.34s ->   15.00s  S0]  text``."""
    return F.format_string("[%7ss -> %7ss  %s]  %s", fixed(t0, 2), fixed(t1, 2), speaker, text)


def response(events: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """All events as one array, in order, and their count; sound is left out."""
    kept = [c for c in events.columns if c != "pcm" and c not in (keys or [])]
    pair = F.struct(F.struct(*order).alias("o"), F.struct(*kept).alias("e"))
    listed = F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["e"])
    return events.groupBy(*(keys or [])).agg(listed.alias("events"), F.count(F.lit(1)).alias("count"))


def merged(utterances: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Both streams in one, each row named by ``event_type``."""
    return utterances.withColumn("event_type", F.lit("utterance")).unionByName(snapshots.withColumn("event_type", F.lit("summary")), allowMissingColumns=True)


def palette(utterances: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), colours: int = 8) -> DataFrame:
    """``keys, speaker, colour``: speakers in the order in which they first spoke, over a palette that begins again."""
    first = utterances.groupBy(*keys, "speaker").agg(F.min("seq").alias("first_seq"))
    return first.withColumn("colour", F.pmod(F.row_number().over(over(keys, ["first_seq"])) - 1, F.lit(colours)))


def final_summary(events: DataFrame, *, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """The last summary that isn't empty, and the number of utterances."""
    said = (F.col("event_type") == "summary") & (F.coalesce(F.col("summary"), F.lit("")) != "")
    return events.groupBy(*keys).agg(F.max_by(F.when(said, F.col("summary")), F.when(said, F.col("seq"))).alias("summary"), F.count_if(F.col("event_type") == "utterance").alias("utterances"))


def transcript(detected: Column, requested: Column, text: Column) -> Column:
    """One-shot answer; the requested language where none was detected."""
    return F.to_json(F.struct(text.alias("text"), F.coalesce(F.nullif(detected, F.lit("")), requested).alias("language")))


def fan_out(subscribers: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: every subscriber gets every batch; one that fails is logged and the others go on."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for subscriber in subscribers:
                try:
                    subscriber(batch, batch_id)
                except Exception:  # a subscriber's failure is its own
                    log.exception("subscriber failed on batch %s", batch_id)
        finally:
            batch.unpersist()

    return each
