"""Rolling summaries: a window of recent speech and what has left it, folded into the summary from time to time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions.columns import fixed
from turnstone.operators.base import ordered_rows, over

RECENT_S, FLUSH_S, FLUSH_N = 60.0, 60.0, 5


def not_blank(utterances: DataFrame, text: str = "text") -> DataFrame:
    return utterances.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")


def recent(utterances: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", window_s: float = RECENT_S) -> DataFrame:
    """Each utterance with ``n_recent`` and ``recent_text``, what was said within ``window_s`` of its end; ends must not decrease."""
    u = not_blank(utterances)
    w = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY t1 RANGE BETWEEN {float(window_s)}D PRECEDING AND CURRENT ROW)"
    said = F.array_sort(F.expr(f"collect_list(struct({order}, text)) {w}"))
    return u.withColumns({"n_recent": F.expr(f"count(1) {w}"), "recent_text": F.array_join(F.transform(said, lambda x: x["text"]), " ")})


def block_line(t0: Column, t1: Column, speaker: Column, text: Column) -> Column:
    return F.format_string("[%s-%s] %s: %s", fixed(t0, 1), fixed(t1, 1), speaker, text)


def blocks(utterances: DataFrame, group: list[str], order: str = "seq") -> DataFrame:
    """One text a group: its lines in order."""
    line = block_line(F.col("t0"), F.col("t1"), F.col("speaker"), F.col("text"))
    return utterances.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


class Analyst:
    """State of one recording. ``summarise(summary, lines)`` may fail: then the summary stays and the block is dropped."""

    def __init__(self, summarise: Callable[[str, list[str]], str], recent_s: float = RECENT_S, flush_s: float | None = FLUSH_S, flush_n: int = FLUSH_N):
        self.summarise, self.recent_s, self.flush_s, self.flush_n = summarise, recent_s, flush_s, flush_n
        self.summary, self.recent, self.pending, self.flushes = "", [], [], 0

    def add(self, u: tuple[float, float, str, str]) -> tuple[float, str, str, int] | None:
        """(t0, t1, speaker, text) -> (time, summary, recent text, flushes); None where nothing is known yet."""
        if not u[3].strip():
            return None
        now = u[1]
        self.recent.append(u)
        while self.recent and now - self.recent[0][1] > self.recent_s:
            self.pending.append(self.recent.pop(0))
        if self.pending:
            due = self.pending[-1][1] - self.pending[0][0] >= self.flush_s if self.flush_s is not None else len(self.pending) >= self.flush_n
            if due:
                self.flush()
        return self.snapshot(now)

    def flush(self) -> None:
        lines = [f"[{a:.1f}-{b:.1f}] {who}: {text}" for a, b, who, text in self.pending]
        self.pending = []
        self.flushes += 1
        try:
            self.summary = str(self.summarise(self.summary, lines)).strip()
        except Exception:  # noqa: BLE001  the model's failure keeps the old summary
            pass

    def snapshot(self, now: float) -> tuple[float, str, str, int] | None:
        said = " ".join(u[3] for u in self.recent)
        return (now, self.summary, said, self.flushes) if self.summary or said else None

    def finish(self) -> tuple[float, str, str, int] | None:
        self.pending += self.recent
        self.recent = []
        if self.pending:
            self.flush()
        return self.snapshot(0.0)


def extract(summary: str, lines: Iterable[str]) -> str:
    """A summary without a model: the first words of each line, after what was there."""
    heads = [" ".join(line.split(": ", 1)[-1].split()[:4]) for line in lines]
    return " / ".join([summary, *heads] if summary else heads)


def snapshots(utterances: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", summarise: Callable[[str, list[str]], str] = extract, recent_s: float = RECENT_S, flush_s: float | None = FLUSH_S, flush_n: int = FLUSH_N) -> DataFrame:
    """``keys, seq, t0, summary, recent, flushes, is_final``: one an utterance, and one at the end, of time 0."""

    def fold(part: dict[str, list]) -> list[tuple]:
        a, out, key = Analyst(summarise, recent_s, flush_s, flush_n), [], tuple(part[k][0] for k in keys)
        for seq, t0, t1, who, text in zip(part[order], part["t0"], part["t1"], part["speaker"], part["text"], strict=True):
            if (s := a.add((t0, t1, who, text or ""))) is not None:
                out.append((*key, seq, *s, False))
        if (s := a.finish()) is not None:
            out.append((*key, None, *s, True))
        return out

    kinds = ", ".join(f"{k} {utterances.schema[k].dataType.simpleString()}" for k in keys)
    times = [F.col(t).cast("double").alias(t) for t in ("t0", "t1")]
    return ordered_rows(utterances.select(*keys, order, *times, "speaker", "text"), keys, [order], fold, f"{kinds}, seq bigint, t0 double, summary string, recent string, flushes int, is_final boolean")


def latest(shots: DataFrame, *, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    return shots.withColumn("_r", F.row_number().over(over(keys, [F.desc("is_final"), F.desc("seq")]))).where("_r = 1").drop("_r")
