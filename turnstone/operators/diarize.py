"""Who speaks: online clustering of segment embeddings, refinement, stitching, turns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.columns import dot, unit
from turnstone.operators.base import dealt, islands, ordered_fold, over, overlap_join, preceding

UNKNOWN = "S?"
JOIN_THRESHOLD, EMA_ALPHA, MIN_SEGMENT_MS, MIN_CLUSTER, STITCH_THRESHOLD = 0.3, 0.1, 500.0, 2, 0.35


def check(join_threshold: float, ema_alpha: float, min_segment_ms: float, max_speakers: int | None, min_cluster: int) -> None:
    """Parameters out of range fail before anything runs."""
    if not 0 < join_threshold < 2:
        raise ValueError("join_threshold must be between 0 and 2")
    if not 0 <= ema_alpha <= 1:
        raise ValueError("ema_alpha must be between 0 and 1")
    if min_segment_ms < 0:
        raise ValueError("min_segment_ms must not be negative")
    if max_speakers is not None and max_speakers < 1:
        raise ValueError("max_speakers must be positive")
    if min_cluster < 1:
        raise ValueError("min_cluster must be positive")


def too_short(t0: Column, t1: Column, min_segment_ms: float = MIN_SEGMENT_MS) -> Column:
    return (t1 - t0) * 1000 < min_segment_ms


class Clusterer:
    """Online centroids of one recording: nearest by cosine distance, the first on ties; joined within the threshold or at the cap, else a new speaker."""

    def __init__(self, join_threshold: float = JOIN_THRESHOLD, ema_alpha: float = EMA_ALPHA, max_speakers: int | None = None):
        self.join, self.alpha, self.cap = join_threshold, ema_alpha, max_speakers
        self.centroids: list[np.ndarray] = []
        self.updates: list[int] = []
        self.last_seen: list[float] = []

    def assign(self, vector: np.ndarray, t: float) -> str:
        length = np.linalg.norm(vector)
        v = vector / length if length > 0 else vector
        if self.centroids:
            far = 1.0 - np.stack(self.centroids) @ v
            k = int(np.argmin(far))
            if far[k] <= self.join or self.cap is not None and len(self.centroids) >= self.cap:
                c = (1 - self.alpha) * self.centroids[k] + self.alpha * v
                length = np.linalg.norm(c)
                self.centroids[k] = c / length if length > 0 else c
                self.updates[k] += 1
                self.last_seen[k] = t
                return f"S{k}"
        self.centroids.append(v)
        self.updates.append(1)
        self.last_seen.append(t)
        return f"S{len(self.centroids) - 1}"


def online_cluster(segments: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", join_threshold: float = JOIN_THRESHOLD, ema_alpha: float = EMA_ALPHA, min_segment_ms: float = MIN_SEGMENT_MS, max_speakers: int | None = None) -> DataFrame:
    """Segments (seq, t0, t1, embedding) with their ``speaker``; those too short or without embedding are ``S?``."""
    check(join_threshold, ema_alpha, min_segment_ms, max_speakers, 1)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        clusters, names = Clusterer(join_threshold, ema_alpha, max_speakers), []
        for t0, t1, e in zip(part["t0"], part["t1"], part["embedding"], strict=True):
            short = (t1 - t0) * 1000 < min_segment_ms
            names.append(UNKNOWN if short or e is None else clusters.assign(np.asarray(e, np.float64), t0))
        return part[[*keys, order, "t0", "t1"]].assign(speaker=names)

    kinds = ", ".join(f"{k} {segments.schema[k].dataType.simpleString()}" for k in keys)
    return ordered_fold(segments.select(*keys, order, F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), "embedding"), keys, [order], fold, f"{kinds}, {order} bigint, t0 double, t1 double, speaker string")


def centroids(segments: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), label: str = "speaker") -> DataFrame:
    """``keys, speaker, centroid, n``: the mean of a speaker's unit embeddings at length one."""
    known = segments.where((F.col(label) != UNKNOWN) & F.col("embedding").isNotNull())
    each = known.select(*keys, label, F.posexplode(unit(F.col("embedding"))).alias("dim", "x"))
    means = each.groupBy(*keys, label, "dim").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    listed = means.groupBy(*keys, label).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("xs"), F.max("n").alias("n"))
    return listed.select(*keys, label, unit(F.transform("xs", lambda p: p["x"])).alias("centroid"), "n")


def single_linkage(cents: DataFrame, merge_threshold: float, *, keys: tuple[str, ...] = ("rec_id",), label: str = "speaker") -> DataFrame:
    """``keys, speaker, group``: speakers joined by chains of distances up to the threshold; a group has the name of its least member (by number)."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(_n=[(len(s), s) for s in part[label]]).sort_values("_n").reset_index(drop=True)
        x = np.stack([np.asarray(c, np.float64) for c in part["centroid"]])
        group = np.arange(len(x))
        near = 1.0 - x @ x.T <= merge_threshold
        while True:
            low = np.where(near | np.eye(len(x), dtype=bool), group[None, :], len(x)).min(1)
            if (low == group).all():
                break
            group = low
        return part[[*keys, label]].assign(group=part[label].to_numpy()[group])

    kinds = ", ".join(f"{k} {cents.schema[k].dataType.simpleString()}" for k in keys)
    return cents.groupBy(*keys).applyInPandas(fold, f"{kinds}, {label} string, group string")


def prune(segments: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", label: str = "speaker", min_cluster: int = MIN_CLUSTER) -> DataFrame:
    """Segments of groups below ``min_cluster`` go, one by one, to the nearest surviving centroid; with no survivor all stay. ``S?`` is left alone."""
    cents = centroids(segments, keys=keys, label=label)
    alive = cents.where(F.col("n") >= min_cluster).select(*keys, F.col(label).alias("s_label"), "centroid")
    sizes = cents.select(*keys, label, "n")
    small = segments.join(sizes, [*keys, label]).where(F.col("n") < min_cluster)
    moved = small.join(alive, [*keys]).withColumn("_d", dot(unit(F.col("embedding")), F.col("centroid")))
    best = moved.withColumn("_r", F.row_number().over(over([*keys, order], [F.desc("_d"), F.length("s_label"), "s_label"]))).where("_r = 1").select(*keys, order, F.col("s_label"))
    return segments.join(best, [*keys, order], "left").withColumn(label, F.coalesce("s_label", F.col(label))).drop("s_label")


def compact_relabel(segments: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", label: str = "speaker") -> DataFrame:
    """Speakers numbered from S0 by first appearance; ``S?`` as it is."""
    known = F.col(label) != UNKNOWN
    first = segments.withColumn("_f", F.min(order).over(over([*keys, label])))
    number = F.dense_rank().over(over([*keys, known], ["_f"])) - 1
    return first.withColumn(label, F.when(known, F.concat(F.lit("S"), number.cast("string"))).otherwise(F.col(label))).drop("_f")


def refine(segments: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", merge_threshold: float = JOIN_THRESHOLD, min_cluster: int = MIN_CLUSTER) -> DataFrame:
    """Labels after the end: merge near speakers, prune small ones, number again."""
    groups = single_linkage(centroids(segments, keys=keys), merge_threshold, keys=keys)
    merged = segments.join(groups, [*keys, "speaker"], "left").withColumn("speaker", F.coalesce("group", "speaker")).drop("group")
    return compact_relabel(prune(merged, keys=keys, order=order, min_cluster=min_cluster), keys=keys, order=order)


def chunk_plan(recordings: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), duration: str = "dur", ideal_s: float, overlap_s: float = 10.0) -> DataFrame:
    """``keys, chunk, t0, t1``: the whole recording where it is short enough, else overlapping chunks up to its end."""
    if overlap_s >= ideal_s:
        raise ValueError("overlap_s must be less than ideal_s")
    step, d = ideal_s - overlap_s, F.col(duration)
    more = F.when(d <= ideal_s + 1e-3, F.lit(0)).otherwise(F.ceil((d - ideal_s) / step)).cast("int")
    at = recordings.select(*keys, d.alias("_d"), F.explode(F.sequence(F.lit(0), more)).alias("chunk"))
    return at.select(*keys, "chunk", (F.col("chunk") * step).alias("t0"), F.when(F.col("_d") <= ideal_s + 1e-3, F.col("_d")).otherwise(F.least(F.col("_d"), F.col("chunk") * step + ideal_s)).alias("t1"))


def average_linkage(x: np.ndarray, threshold: float) -> np.ndarray:
    """Group of each unit vector: average-linkage clustering on cosine distances, merged while the nearest groups are closer than ``threshold``; groups are numbered by their first member.

    The average distance of two groups is 1 minus the product of their means, so
    means are kept and no matrix of distances: memory grows with the vectors,
    time with their square. Each group knows its nearest later one. Merging never
    brings groups closer, so what a group knew stays a lower bound when that one
    is gone, and it is looked for again only when its turn comes. A vector that
    holds no numbers stays alone.
    """
    ids = np.arange(len(x))
    parent, mean, size = ids.copy(), np.array(x, np.float64), np.ones(len(x))
    near, host, stale = np.full(len(x), np.inf), ids.copy(), np.ones(len(x), bool)

    def look(rows: np.ndarray) -> None:
        """Nearest of the later groups for ``rows``, in ascending order."""
        first = int(rows[0]) + 1
        d = np.maximum(1.0 - mean[rows] @ mean[first:].T, 0.0)
        d[np.isnan(d)] = np.inf
        d[:, size[first:] == 0] = np.inf
        for k, row in enumerate(rows[1:] - rows[0], 1):
            d[k, :row] = np.inf
        if d.shape[1]:
            to = d.argmin(1)
            near[rows], host[rows] = d[np.arange(len(rows)), to], to + first
        stale[rows] = False

    for k in range(0, len(ids), 64):
        look(np.arange(k, min(k + 64, len(ids))))
    gone = 0
    while len(ids):
        a = int(np.argmin(near))
        if not near[a] < threshold:
            break
        if stale[a]:
            rows = np.flatnonzero(stale & (near <= np.min(near, where=~stale, initial=np.inf)) & (near < threshold))
            look(np.sort(rows[np.argsort(near[rows], kind="stable")[:64]]))
            continue
        b = int(host[a])
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[a] += size[b]
        size[b], near[b], stale[b], parent[ids[b]] = 0, np.inf, False, ids[a]
        stale[: b][((host[:b] == a) | (host[:b] == b)) & (size[:b] > 0) & (near[:b] < np.inf)] = True
        look(np.array([a]))
        gone += 1
        if gone > 64 and gone > len(ids) // 4:
            kept = np.flatnonzero(size > 0)
            place = np.full(len(ids), -1)
            place[kept] = np.arange(len(kept))
            ids, mean, size, near, stale, host = ids[kept], mean[kept], size[kept], near[kept], stale[kept], place[host[kept]]
            gone = 0
    for k, up in enumerate(parent):  # a parent comes before its children
        parent[k] = parent[up]
    return np.unique(parent, return_inverse=True)[1]


def stitch(spans: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), threshold: float = STITCH_THRESHOLD) -> DataFrame:
    """Chunk-local speakers (chunk, speaker, embedding) -> one ``speaker`` over the recording; spans without embedding go. A task holds one recording's vectors."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["chunk", "local"]).reset_index(drop=True)
        x = np.stack([np.asarray(e, np.float64) for e in part["embedding"]])
        length = np.linalg.norm(x, axis=1, keepdims=True)
        groups = average_linkage(np.where(length > 0, x / np.where(length > 0, length, 1), x), threshold)
        return part[[*keys, "chunk", "local"]].assign(speaker=[f"S{g}" for g in groups])

    kinds = ", ".join(f"{k} {spans.schema[k].dataType.simpleString()}" for k in keys)
    once = spans.where("embedding IS NOT NULL").select(*keys, F.col("chunk").cast("int").alias("chunk"), F.col("local").cast("string").alias("local"), "embedding").dropDuplicates([*keys, "chunk", "local"])
    parts = 16 * spans.sparkSession.sparkContext.defaultParallelism  # long recordings are few bytes and much work
    return once.repartition(parts, *keys).groupBy(*keys).applyInPandas(fold, f"{kinds}, chunk int, local string, speaker string")


def _runs(spans: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Spans with the number of their run of one speaker, whether they begin one, and how far the run reached before them. All from one sort by key and order: runs are numbered in order, so the greatest (run, end) so far is this run's if it has one."""
    w = dealt(spans, keys).withColumn("_p", F.lag("speaker").over(over(keys, order)))
    w = w.withColumn("_new", ~F.col("speaker").eqNullSafe(F.col("_p")))
    most = F.max(F.struct("_run", "t1")).over(preceding(keys, order))
    return islands(w, keys, order, F.col("_new"), "_run").withColumn("_most", most).withColumn("_reach", F.when(F.col("_most._run") == F.col("_run"), F.col("_most.t1")))


def merge_spans(spans: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: tuple[str, ...] = ("t0", "seq"), slack: float = 1e-3) -> DataFrame:
    """Spans in order; a span joins the one before it if the speaker is the same and it begins before that one's end."""
    far = F.coalesce(F.col("t0") > F.col("_reach") + slack, F.lit(False))
    parts = islands(_runs(spans, keys, order), keys, order, F.col("_new") | far, "_part")
    return parts.groupBy(*keys, "speaker", "_part").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count(F.lit(1)).alias("n")).drop("_part")


def slice_bounds(t0: Column, t1: Column, n: Column, sample_rate: int = 16_000) -> tuple[Column, Column]:
    """First and end sample of a span within n samples, rounded half to even."""
    at = lambda t: F.bround(t * sample_rate).cast("bigint")
    return F.greatest(F.lit(0), at(t0)), F.least(n, at(t1))


def turns(words: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: tuple[str, ...] = ("t0", "seq"), gap_s: float | None = None, per_speaker: bool = False, text: str | None = None) -> DataFrame:
    """Words or spans joined to turns: neighbours of one speaker, at most ``gap_s`` apart (None: any gap). ``per_speaker`` looks at each speaker alone, over what others say between."""
    group = [*keys, "speaker"] if per_speaker else [*keys]
    far = F.coalesce(F.col("t0") - F.col("_reach") > gap_s, F.lit(False)) if gap_s is not None else F.lit(False)
    if per_speaker:
        w = dealt(words, group).withColumn("_reach", F.max("t1").over(preceding(group, order)))
    else:
        w, far = _runs(words, keys, order), F.col("_new") | far
    parts = islands(w, group, order, far, "_part")
    out = [F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count(F.lit(1)).alias("n")]
    if text is not None:
        out.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_w")))), lambda x: x["_w"]), " ").alias("text"))
    return parts.groupBy(*keys, "speaker", "_part").agg(*out).drop("_part")


def dominant_speaker(segments: DataFrame, reference: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), segment: str = "seg_id", bucket_s: float | None = None) -> DataFrame:
    """``keys, seg_id, speaker, overlap``: who speaks longest within each segment; segments nobody speaks in are left out."""
    pairs = overlap_join(segments.select(*keys, segment, "t0", "t1"), reference.select(*keys, F.col("t0").alias("s0"), F.col("t1").alias("s1"), "speaker"), list(keys), bucket_s=bucket_s)
    total = pairs.groupBy(*keys, segment, "speaker").agg(F.sum(F.least("t1", "s1") - F.greatest("t0", "s0")).alias("overlap"))
    return total.withColumn("_r", F.row_number().over(over([*keys, segment], [F.desc("overlap"), "speaker"]))).where("_r = 1").drop("_r")


def speech_seconds(spans: DataFrame, *, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Talk time a speaker, with its share of the recording's."""
    each = spans.groupBy(*keys, "speaker").agg(F.sum(F.col("t1") - F.col("t0")).alias("seconds"))
    return each.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy(*keys)))


def slice_pcm(pcm: np.ndarray, t0: float, t1: float, sample_rate: int, least_s: float = 0.0) -> np.ndarray:
    """The samples of a span, padded with zeros to ``least_s``."""
    a, b = max(0, round(t0 * sample_rate)), min(len(pcm), round(t1 * sample_rate))
    x = pcm[a : max(a, b)]
    return np.pad(x, (0, max(0, math.ceil(least_s * sample_rate) - len(x))))
