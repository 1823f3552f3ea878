"""Streaming twins of the keyed folds, over ``applyInPandasWithState``.

Rows of a key are folded in the order of ``seq``, within a micro-batch and
across: rows ahead of the next expected number wait in the state, rows behind
it are late and dropped. A row with ``is_last`` (or silence longer
than ``idle_ms`` of processing time) ends the recording and lets go of what is
held, rows that waited behind a lost one too, so a lost row stalls no recording
for longer than it speaks. None for ``idle_ms`` waits for ever; a query with the
trigger ``availableNow`` needs it, since timeouts keep a query running. Batch
and stream share one fold each, so their results are equal.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from types import SimpleNamespace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnstone.operators.diarize import UNKNOWN, Clusterer
from turnstone.operators.summary import Analyst, extract

_STATE = "body binary"
#: Silence that ends a recording.
IDLE_MS = 600_000


def keyed_fold(stream: DataFrame, key: str, start: Callable[[], Any], step: Callable[[Any, Any], list[tuple]], finish: Callable[[Any], list[tuple]], schema: str, *, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """``step(state, row)`` and ``finish(state)`` give result rows without the key; rows need ``seq`` (from 0) and ``is_last``."""
    names = [c.split()[0] for c in schema.split(", ")]
    kind = stream.schema[key].dataType.simpleString()

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        body, following, waiting = pickle.loads(state.get[0]) if state.exists else (start(), 0, {})
        out: list[tuple] = []
        if state.hasTimedOut:
            for seq in sorted(waiting):
                out += step(body, waiting[seq])
            out += finish(body)
            state.remove()
        else:
            for batch in batches:
                for row in batch.to_dict("records"):
                    if row["seq"] >= following:
                        waiting[int(row["seq"])] = SimpleNamespace(**row)
            ended = False
            while following in waiting and not ended:
                row = waiting.pop(following)
                following += 1
                out += step(body, row)
                ended = bool(row.is_last)
            if ended:
                out += finish(body)
                state.remove()
            else:
                state.update((pickle.dumps((body, following, waiting)),))
                if idle_ms is not None:
                    state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(*keys, *r) for r in out], columns=[key, *names])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {schema}", _STATE, "append", timeout)


class VoiceRun:
    """State of voice activity: the open run, and how far the recording has come."""

    def __init__(self, threshold: float, min_silence_ms: float, min_speech_ms: float, edge_pad_ms: float, sample_rate: int, window: int):
        self.threshold, self.silence, self.speech, self.pad, self.rate, self.window = threshold, min_silence_ms, min_speech_ms, edge_pad_ms / 1000, sample_rate, window
        self.start: int | None = None
        self.stop = self.total = self.n = 0

    def close(self, stop: int) -> list[tuple]:
        t0, t1 = max(0.0, self.start / self.rate - self.pad), stop / self.rate + self.pad
        self.start = None
        if (t1 - t0) * 1000 < self.speech:
            return []
        self.n += 1
        return [(self.n - 1, t0, t1)]

    def add(self, start_sample: int, score: float) -> list[tuple]:
        self.total = start_sample + self.window
        if score >= self.threshold:
            if self.start is None:
                self.start = start_sample
            self.stop = self.total
        elif self.start is not None and (self.total - self.stop) / (self.rate / 1000) >= self.silence:
            return self.close(self.stop)
        return []

    def finish(self) -> list[tuple]:
        return self.close(self.total) if self.start is not None else []


def voiced_segments(stream: DataFrame, *, key: str = "rec_id", threshold: float = 0.5, min_silence_ms: float = 300, min_speech_ms: float = 300, edge_pad_ms: float = 200, sample_rate: int = 16_000, window: int = 512, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Windows (seq, start_sample, score, is_last) -> ``seg_id, t0, t1``."""
    return keyed_fold(
        stream, key, lambda: VoiceRun(threshold, min_silence_ms, min_speech_ms, edge_pad_ms, sample_rate, window), lambda s, r: s.add(int(r.start_sample), float(r.score)), lambda s: s.finish(), "seg_id bigint, t0 double, t1 double", idle_ms=idle_ms
    )


def online_cluster(stream: DataFrame, *, key: str = "rec_id", join_threshold: float = 0.3, ema_alpha: float = 0.1, min_segment_ms: float = 500, max_speakers: int | None = None, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Segments (seq, t0, t1, embedding, is_last) -> ``seq, t0, t1, speaker``."""

    def step(state: Clusterer, row: Any) -> list[tuple]:
        short = (row.t1 - row.t0) * 1000 < min_segment_ms or row.embedding is None
        return [(int(row.seq), row.t0, row.t1, UNKNOWN if short else state.assign(np.asarray(row.embedding, np.float64), row.t0))]

    return keyed_fold(stream, key, lambda: Clusterer(join_threshold, ema_alpha, max_speakers), step, lambda s: [], "seq bigint, t0 double, t1 double, speaker string", idle_ms=idle_ms)


def summaries(stream: DataFrame, *, key: str = "rec_id", recent_s: float = 60.0, flush_s: float | None = 60.0, flush_n: int = 5, summarise: Callable[[str, list[str]], str] = extract, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Utterances (seq, t0, t1, speaker, text, is_last) -> ``t0, summary, recent, flushes, is_final``."""

    def step(state: Analyst, row: Any) -> list[tuple]:
        shot = state.add((row.t0, row.t1, row.speaker, row.text or ""))
        return [(*shot, False)] if shot else []

    def finish(state: Analyst) -> list[tuple]:
        shot = state.finish()
        return [(*shot, True)] if shot else []

    return keyed_fold(stream, key, lambda: Analyst(summarise, recent_s, flush_s, flush_n), step, finish, "t0 double, summary string, recent string, flushes int, is_final boolean", idle_ms=idle_ms)


class Holding:
    """State of end-of-turn gating: what is held back."""

    def __init__(self, max_merge_s: float, min_incomplete_ms: float):
        self.longest, self.least, self.held = max_merge_s, min_incomplete_ms, None

    def add(self, seq: int, t0: float, t1: float, complete: bool) -> list[tuple]:
        if self.held is None and (t1 - t0) * 1000 >= self.least:
            return [(seq, seq, t0, t1)]
        self.held = (seq, seq, t0, t1) if self.held is None else (self.held[0], seq, self.held[2], t1)
        if self.held[3] - self.held[2] >= self.longest or complete:
            return self.finish()
        return []

    def finish(self) -> list[tuple]:
        held, self.held = self.held, None
        return [held] if held else []


def merge_turns(stream: DataFrame, *, key: str = "rec_id", max_merge_s: float = 4.0, min_incomplete_ms: float = 800.0, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Segments (seq, t0, t1, complete, is_last) -> ``first_seq, last_seq, t0, t1``."""
    return keyed_fold(stream, key, lambda: Holding(max_merge_s, min_incomplete_ms), lambda s, r: s.add(int(r.seq), r.t0, r.t1, bool(r.complete)), lambda s: s.finish(), "first_seq bigint, last_seq bigint, t0 double, t1 double", idle_ms=idle_ms)
