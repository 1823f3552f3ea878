"""Language regions: posteriors over sliding windows, smoothing, change points, absorption, boundaries."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators.base import islands, ordered_fold, over

#: Language, start and end.
Region = tuple[str, float, float]
WINDOW_S, HOP_S, SMOOTH_S, MIN_REGION_S, REFINE_S, SNAP_S, GATE = 10.0, 3.0, 6.0, 8.0, 4.0, 1.0, 0.5


def top_language(posteriors: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), supported: tuple[str, ...] | None = None) -> DataFrame:
    """``keys, lang, p``: the likeliest language; with a whitelist the likeliest of it, codes that are missing counting 0 and the first listed winning ties."""
    if supported is None:
        order = [F.desc("p"), "lang"]
        return posteriors.withColumn("_r", F.row_number().over(over(keys, order))).where("_r = 1").select(*keys, "lang", "p")
    codes = F.array(*[F.lit(c) for c in supported])
    found = posteriors.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("lang", "p"))).alias("m"))
    every = found.select(*keys, "m", F.posexplode(codes).alias("i", "lang")).withColumn("p", F.coalesce(F.element_at("m", F.col("lang")), F.lit(0.0)))
    return every.withColumn("_r", F.row_number().over(over(keys, [F.desc("p"), "i"]))).where("_r = 1").select(*keys, "lang", "p")


def window_plan(recordings: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), duration: str = "dur", window_s: float = WINDOW_S, hop_s: float = HOP_S) -> DataFrame:
    """``keys, k, center, w0, w1``: centred windows, clamped to the recording; those under a second are left out."""
    d = F.col(duration)
    n = F.ceil(F.greatest(d, F.lit(hop_s)) / hop_s) - 1
    at = recordings.select(*keys, d.alias("_d"), F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("k")).withColumn("center", F.col("k") * hop_s)
    cut = at.withColumns({"w0": F.greatest(F.lit(0.0), F.col("center") - window_s / 2), "w1": F.least(F.col("_d"), F.col("center") + window_s / 2)})
    return cut.where("w1 - w0 >= 1").drop("_d")


def posterior_curve(scores: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), supported: tuple[str, ...] | None = None) -> DataFrame:
    """Window scores (k, center, lang, p) on one axis, each window summing to one.

    The axis is the whitelist or the languages of the first window; a window
    without mass on it is uniform.
    """
    if supported is None:
        axis = scores.withColumn("_k", F.min("k").over(over(keys))).where("k = _k").select(*keys, "lang").distinct()
    else:
        axis = scores.select(*keys).distinct().withColumn("lang", F.explode(F.array(*[F.lit(c) for c in sorted(supported)])))
    grid = scores.select(*keys, "k", "center").distinct().join(axis, [*keys])
    full = grid.join(scores.select(*keys, "k", "lang", "p"), [*keys, "k", "lang"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    w = over([*keys, "k"])
    total = F.sum("p").over(w)
    return full.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(1.0 / F.count(F.lit(1)).over(w)))


def gaussian(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth(curve: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), sigma: float = SMOOTH_S / HOP_S) -> DataFrame:
    """``p`` by a Gaussian over k within each language; beyond the ends stands the nearest value. k must be 0, 1, 2, ..."""
    weights = gaussian(sigma)
    r = len(weights) // 2
    listed = curve.groupBy(*keys, "lang").agg(F.array_sort(F.collect_list(F.struct("k", "center", "p"))).alias("xs"))
    kernel = F.array(*[F.lit(w) for w in weights])
    n = F.size("xs")

    def at(x: Column, i: Column) -> Column:
        inner = F.transform(kernel, lambda w, j: w * F.get(F.col("xs"), F.greatest(F.lit(0), F.least(n - 1, i + j - r)))["p"])
        return F.struct(x["k"].alias("k"), x["center"].alias("center"), F.aggregate(inner, F.lit(0.0), lambda s, y: s + y).alias("p"))

    return listed.select(*keys, "lang", F.explode(F.transform("xs", at)).alias("x")).select(*keys, "lang", "x.*")


def frame_languages(curve: DataFrame, *, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """``keys, k, center, lang``: the likeliest of each frame, the first in the alphabet on ties."""
    return curve.withColumn("_r", F.row_number().over(over([*keys, "k"], [F.desc("p"), "lang"]))).where("_r = 1").select(*keys, "k", "center", "lang")


def change_points(frames: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), duration: str = "dur") -> DataFrame:
    """``keys, region_id, lang, t0, t1``: runs of one language; borders half way between frames, 0 and the end outside."""
    w = frames.withColumns({"_p": F.lag("lang").over(over(keys, ["k"])), "_pc": F.lag("center").over(over(keys, ["k"]))})
    runs = islands(w, keys, ["k"], F.col("_p").isNotNull() & (F.col("_p") != F.col("lang")), "region_id")
    out = runs.groupBy(*keys, "region_id").agg(F.first("lang").alias("lang"), F.min(F.struct("k", "center", "_pc")).alias("f"), F.max(duration).alias("_d"))
    t0 = F.when(F.col("region_id") == 0, F.lit(0.0)).otherwise((F.col("f._pc") + F.col("f.center")) / 2)
    out = out.withColumn("t0", t0)
    return out.withColumn("t1", F.coalesce(F.lead("t0").over(over(keys, ["region_id"])), F.col("_d").cast("double"))).select(*keys, F.col("region_id").cast("bigint").alias("region_id"), "lang", "t0", "t1")


def coalesce_regions(regions: DataFrame, *, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Neighbours of one language as one region."""
    w = regions.withColumn("_p", F.lag("lang").over(over(keys, ["region_id"])))
    runs = islands(w, keys, ["region_id"], F.col("_p").isNotNull() & (F.col("_p") != F.col("lang")), "_run")
    out = runs.groupBy(*keys, "_run").agg(F.first("lang").alias("lang"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    return out.select(*keys, F.col("_run").cast("bigint").alias("region_id"), "lang", "t0", "t1")


def absorbed(regions: list[Region], least_s: float) -> list[Region]:
    """Regions under ``least_s``, the shortest first, take the language of the longer neighbour (the left one if equal) until none is left or one is."""

    def joined(rs: list[Region]) -> list[Region]:
        out: list[Region] = []
        for r in rs:
            if out and out[-1][0] == r[0]:
                out[-1] = (r[0], out[-1][1], r[2])
            else:
                out.append(r)
        return out

    rs = joined(regions)
    lang, start, end = ([r[k] for r in rs] for k in range(3))
    left, right = list(range(-1, len(rs) - 1)), [*range(1, len(rs)), -1]
    alive, n = [True] * len(rs), len(rs)
    size = lambda k: end[k] - start[k]
    short = [(size(k), k) for k in range(n) if size(k) < least_s]
    heapq.heapify(short)
    while short and n > 1:
        length, k = heapq.heappop(short)
        if not alive[k] or length != size(k):
            continue
        a, b = left[k], right[k]
        lang[k] = lang[b] if a < 0 or b >= 0 and size(b) > size(a) else lang[a]
        for first, second in ((k, b), (a, k)):
            if first >= 0 and second >= 0 and lang[first] == lang[second]:
                end[first], right[first], alive[second], k = end[second], right[second], False, first
                if right[first] >= 0:
                    left[right[first]] = first
                n -= 1
        if size(k) < least_s:
            heapq.heappush(short, (size(k), k))
    return [(lang[k], start[k], end[k]) for k in range(len(rs)) if alive[k]]


def absorb_short(regions: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), min_region_s: float = MIN_REGION_S) -> DataFrame:
    def fold(part: pd.DataFrame) -> pd.DataFrame:
        rs = absorbed(list(zip(*[part[c].tolist() for c in ("lang", "t0", "t1")], strict=True)), min_region_s)
        out = pd.DataFrame(rs, columns=["lang", "t0", "t1"])
        out.insert(0, "region_id", range(len(rs)))
        for k in reversed(keys):
            out.insert(0, k, part[k].iloc[0])
        return out

    kinds = ", ".join(f"{k} {regions.schema[k].dataType.simpleString()}" for k in keys)
    return ordered_fold(regions.select(*keys, "region_id", "lang", "t0", "t1"), keys, ["region_id"], fold, f"{kinds}, region_id bigint, lang string, t0 double, t1 double")


def crossing(centers: np.ndarray, gain: np.ndarray, coarse: float) -> float | None:
    """Where ``gain`` goes from 0 or less to above, interpolated, nearest to ``coarse``; the first on ties."""
    if len(gain) >= 3:
        w = np.array(gaussian(1.0))
        r = len(w) // 2
        at = np.clip(np.arange(len(gain))[:, None] + np.arange(-r, r + 1), 0, len(gain) - 1)
        gain = gain[at] @ w
    up = np.flatnonzero((gain[:-1] <= 0) & (gain[1:] > 0)) if len(gain) >= 2 else []
    points = [centers[k] + (centers[k + 1] - centers[k]) * -gain[k] / (gain[k + 1] - gain[k]) for k in up]
    return min(points, key=lambda p: abs(p - coarse)) if len(points) else None


def refine_boundaries(regions: DataFrame, probes: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), radius_s: float = REFINE_S) -> DataFrame:
    """Borders moved, from left to right, to where the next region's posterior overtakes: ``probes`` (t, lang, p) are posteriors on a fine grid."""

    def fold(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rs = left.sort_values("region_id").reset_index(drop=True)
        grid = right.pivot_table(index="t", columns="lang", values="p", aggfunc="first").sort_index().fillna(0.0) if len(right) else pd.DataFrame()
        t0, t1 = rs["t0"].tolist(), rs["t1"].tolist()
        for i in range(len(rs) - 1):
            border = t1[i]
            lo, hi = max(t0[i], border - radius_s), min(t1[i + 1], border + radius_s)
            near = grid[(grid.index >= lo) & (grid.index <= hi)]
            zero = np.zeros(len(near))
            gain = (near[rs["lang"][i + 1]].to_numpy() if rs["lang"][i + 1] in near else zero) - (near[rs["lang"][i]].to_numpy() if rs["lang"][i] in near else zero)
            found = crossing(near.index.to_numpy(float), gain, border)
            border = min(max(border if found is None else found, t0[i] + 1e-3), t1[i + 1] - 1e-3)
            t1[i] = t0[i + 1] = border
        return rs.assign(t0=t0, t1=t1)[[*keys, "region_id", "lang", "t0", "t1"]]

    kinds = ", ".join(f"{k} {regions.schema[k].dataType.simpleString()}" for k in keys)
    return regions.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(fold, f"{kinds}, region_id bigint, lang string, t0 double, t1 double")


def snap_to_silence(regions: DataFrame, energy: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), snap_s: float = SNAP_S) -> DataFrame:
    """Inner borders moved to the middle of the quietest frame (t, rms) within ``snap_s``, the first on ties."""
    r = regions.withColumn("_last", F.lead("region_id").over(over(keys, ["region_id"])).isNull())
    borders = r.where("NOT _last").select(*keys, "region_id", F.col("t1").alias("_b"))
    near = borders.join(energy, [*keys]).where(F.abs(F.col("t") - F.col("_b")) <= snap_s)
    best = near.groupBy(*keys, "region_id").agg(F.min_by("t", F.struct("rms", "t")).alias("_s"))
    moved = r.join(best, [*keys, "region_id"], "left").withColumn("t1", F.coalesce("_s", "t1"))
    t0 = F.coalesce(F.lag("t1").over(over(keys, ["region_id"])), F.col("t0"))
    return moved.withColumn("t0", t0).select(*keys, "region_id", "lang", "t0", "t1")


def fast_gate(globals_: DataFrame, *, supported: tuple[str, ...] | None = None, gate: float = GATE) -> DataFrame:
    """Recordings (lang, p, dur) as ``plan``: one region where the language is sure and can be routed, a scan where not, nothing where empty."""
    routable = F.col("lang").isin(*supported) if supported is not None else F.lit(True)
    return globals_.withColumn("plan", F.when(F.col("dur") <= 0, "none").when((F.col("p") >= gate) & routable, "single").otherwise("scan"))


def regions_fast(globals_: DataFrame, frames: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), supported: tuple[str, ...] | None = None, gate: float = GATE) -> DataFrame:
    """``keys, region_id, lang, t0, t1``: one region for recordings that ``fast_gate`` is sure of, the change points of ``frames`` for the others, none for empty ones."""
    plan = fast_gate(globals_, supported=supported, gate=gate)
    sure = plan.where("plan = 'single'").select(*keys, F.lit(0).cast("bigint").alias("region_id"), "lang", F.lit(0.0).alias("t0"), F.col("dur").cast("double").alias("t1"))
    scanned = frames.join(plan.where("plan = 'scan'").select(*keys), [*keys], "left_semi")
    return sure.unionByName(change_points(scanned, keys=keys))


def label_of(answer: Column, supported: tuple[str, ...] | None = None) -> Column:
    """Language code of a "code: name" label; one that isn't listed becomes the first listed."""
    code = F.lower(F.trim(F.split_part(answer, F.lit(":"), F.lit(1))))
    return code if supported is None else F.when(code.isin(*supported), code).otherwise(F.lit(supported[0]))


def cross_check(regions: DataFrame, second: DataFrame, *, keys: tuple[str, ...] = ("rec_id", "region_id")) -> DataFrame:
    """``t0, t1, primary, second, p, agree``: another model's opinion on each region; regions under a second agree with ``-`` at 0."""
    both = regions.join(second.select(*keys, F.col("lang").alias("_s"), F.col("p").alias("_p")), [*keys], "left")
    short = F.col("t1") - F.col("t0") < 1
    return both.select(*keys, "t0", "t1", F.col("lang").alias("primary"), F.when(short, "-").otherwise(F.col("_s")).alias("second"), F.when(short, 0.0).otherwise(F.col("_p")).alias("p"), F.when(short, True).otherwise(F.col("_s").eqNullSafe(F.col("lang"))).alias("agree"))
