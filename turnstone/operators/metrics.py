"""Scores of detectors, transcripts and diarizations, and how runs compare."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.operators.base import ordered_fold, over, preceding, upto

BANDS_MS, TOLERANCE_MS = (300, 600, 1200), 50
#: Of ``separability``: vectors of a block, rows taken at once, distances a vector that may be listed, bits left off by each count, what stands for a distance that is no number.
BLOCK, TILE, FEW, BITS, NO_NUMBER = 4096, 128, 64, (42, 22, 0), 256.0


def false_cutoff_rate(latency: Column, tolerance_s: float) -> Column:
    """Share of commits more than the tolerance before the true end; a negative tolerance fails once there are rows."""
    if tolerance_s < 0:
        return F.when(F.count(F.lit(1)) > 0, F.raise_error(F.lit("tolerance must not be negative"))).otherwise(F.lit(0.0)).cast("double")
    return F.coalesce(F.avg((latency < -tolerance_s).cast("double")), F.lit(0.0))


def hang_rate(latency: Column, budget_s: float) -> Column:
    return F.coalesce(F.avg((latency > budget_s).cast("double")), F.lit(0.0))


def eot_score(pairs: DataFrame, *, keys: tuple[str, ...] = (), bands_ms: tuple[int, ...] = BANDS_MS, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """``n, median_ms, cutoff, hang_<band>`` of pairs (true_s, commit_s)."""
    late = F.col("commit_s") - F.col("true_s")
    hangs = [hang_rate(late, b / 1000).alias(f"hang_{b}") for b in bands_ms]
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.median(late), F.lit(0.0)) * 1000).alias("median_ms"), false_cutoff_rate(late, tolerance_ms / 1000).alias("cutoff"), *hangs)


def edit_distance(a: list[str], b: list[str]) -> int:
    """Words to insert, delete or replace. Each row is one vectorised step; insertions are a running minimum."""
    index = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
    x, y = np.array([index[w] for w in a], np.int64), np.array([index[w] for w in b], np.int64)
    if len(x) < len(y):
        x, y = y, x
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for k, w in enumerate(x):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[:-1] + (y != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def wer(pairs: DataFrame, *, reference: str = "reference", hypothesis: str = "hypothesis", normalise: Callable[[str], str] | None = None) -> DataFrame:
    """``pairs`` with ``distance, ref_words, wer``: word edits for each reference word; an empty reference has 1.0."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            words = [[(normalise(t) if normalise else t).split() for t in p[c].fillna("")] for c in (reference, hypothesis)]
            d = [edit_distance(a, b) for a, b in zip(*words, strict=True)]
            n = [len(a) for a in words[0]]
            yield p.assign(distance=d, ref_words=n, wer=[x / k if k else 1.0 for x, k in zip(d, n, strict=True)])

    return pairs.mapInPandas(run, f"{schema}, distance int, ref_words int, wer double")


def best_mapping(overlap: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns, each used once, with the largest total (shortest augmenting paths)."""
    flip = overlap.shape[0] > overlap.shape[1]
    cost = -(overlap.T if flip else overlap)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def der_parts(ref: list[tuple[float, float, str]], hyp: list[tuple[float, float, str]], collar: float = 0.25) -> tuple[float, float, float, float]:
    """(missed, false alarm, confused, reference speech) in seconds, a collar on both sides of every reference border left out."""
    borders = sorted({t for a, b, _ in ref for t in (a, b)})
    cuts = np.array(sorted({t for a, b, _ in ref + hyp for t in (a, b)} | {t + s * collar for t in borders for s in (-1, 1)}))
    if len(cuts) < 2:
        return 0.0, 0.0, 0.0, 0.0
    mid, size = (cuts[1:] + cuts[:-1]) / 2, np.diff(cuts)
    if collar:
        size = np.where(np.any([np.abs(mid - t) < collar for t in borders], axis=0), 0.0, size) if borders else size

    def active(spans: list[tuple[float, float, str]]) -> np.ndarray:
        names = sorted({s for _, _, s in spans})
        out = np.zeros((len(names), len(mid)), bool)
        for a, b, s in spans:
            out[names.index(s)] |= (mid >= a) & (mid < b)
        return out

    r, h = active(ref), active(hyp)
    right = np.zeros(len(mid))
    if len(r) and len(h):
        for i, j in best_mapping((r * size).astype(float) @ h.T.astype(float)):
            right += r[i] & h[j]
    nr, nh = r.sum(0), h.sum(0)
    return float((size * np.maximum(0, nr - nh)).sum()), float((size * np.maximum(0, nh - nr)).sum()), float((size * (np.minimum(nr, nh) - right)).sum()), float((size * nr).sum())


def der(reference: DataFrame, hypothesis: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), collar: float = 0.25) -> DataFrame:
    """``keys, missed, false_alarm, confused, speech, der`` of spans (t0, t1, speaker)."""

    def fold(key: tuple, r: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        spans = [list(zip(x["t0"], x["t1"], x["speaker"], strict=True)) for x in (r, h)]
        miss, false, wrong, speech = der_parts(*spans, collar)
        return pd.DataFrame([(*key, miss, false, wrong, speech, (miss + false + wrong) / speech if speech else None)], columns=[*keys, "missed", "false_alarm", "confused", "speech", "der"])

    kinds = ", ".join(f"{k} {reference.schema[k].dataType.simpleString()}" for k in keys)
    return reference.groupBy(*keys).cogroup(hypothesis.groupBy(*keys)).applyInPandas(fold, f"{kinds}, missed double, false_alarm double, confused double, speech double, der double")


def tfidf_cosine(pairs: DataFrame, *, key: str = "pair_id", a: str = "a", b: str = "b") -> DataFrame:
    """``key, cosine`` of two texts, terms weighted over the two; 0 where one has no term."""
    terms = lambda c, side: pairs.select(key, F.lit(side).alias("side"), F.explode(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit("([a-zA-Z]{2,})"), F.lit(1))).alias("t"))
    tf = terms(a, 0).union(terms(b, 1)).groupBy(key, F.lower("t").alias("t")).agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"))
    idf = F.ln(1 + F.lit(2.0) / ((F.col("na") > 0).cast("int") + (F.col("nb") > 0).cast("int")))
    w = tf.withColumns({"wa": F.col("na") * idf, "wb": F.col("nb") * idf})
    sums = w.groupBy(key).agg(F.sum(F.col("wa") * F.col("wb")).alias("ab"), F.sum(F.col("wa") ** 2).alias("aa"), F.sum(F.col("wb") ** 2).alias("bb"))
    value = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa")) / F.sqrt(F.col("bb")))
    return pairs.select(key).join(sums.select(key, value.alias("cosine")), key, "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-case words; two empty sets are alike."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9']+)"), F.lit(1)))
    both = F.size(F.array_union(words(a), words(b)))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(words(a), words(b))) / both)


def pair_bins(x: np.ndarray, codes: np.ndarray, rank: np.ndarray, cut: int, ranges: dict[int, tuple[int | None, float, float, int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Cosine distances counted by bin, for pairs of one label (1) and of two (0): those of rows before ``cut`` with rows from there on or, with ``cut`` 0, of all rows with rows of higher ``rank``.

    Distances are whole multiples of 2^-53, since they are 1 minus a product; a
    bin leaves off their last ``to`` bits. ``ranges``: (at, lo, hi, to) by kind,
    only bins lo to hi without the last ``at`` bits count (None: all). A distance
    that is no number counts as NO_NUMBER.
    """
    left, right = (slice(0, cut), slice(cut, None)) if cut else (slice(None), slice(None))
    a, b, ca, cb = x[left], x[right], codes[left], codes[right]
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in ranges}
    for k in range(0, len(a), TILE):
        d = 1.0 - a[k : k + TILE] @ b.T
        d[np.isnan(d)] = NO_NUMBER
        same = ca[k : k + TILE, None] == cb[None, :]
        later = None if cut else rank[k : k + TILE, None] < rank[None, :]
        for kind, (at, lo, hi, to) in ranges.items():
            of = same if kind else ~same
            y = d[of if later is None else of & later]
            if at is not None:
                z = np.floor(y * 2.0 ** (53 - at))
                y = y[(z >= lo) & (z <= hi)]
            if len(y):
                z = np.floor(y * 2.0 ** (53 - to)).astype(np.int64)
                least = z.min()
                if z.max() - least < 1 << 16:
                    n = np.bincount(z - least)
                    at_ = np.flatnonzero(n)
                    found[kind].append((at_ + least, n[at_]))
                else:
                    found[kind].append(np.unique(z, return_counts=True))
    out = {}
    for kind, parts in found.items():
        if parts:
            bins, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            out[kind] = bins, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
    return out


def separability(vectors: DataFrame, *, keys: tuple[str, ...] = ("rec_id",), order: str = "seq", label: str = "speaker", block: int = BLOCK) -> DataFrame:
    """``keys, intra, inter, margin``: median cosine distances within and between speakers, over all pairs.

    Exact, and no pair is kept: a recording's vectors are dealt to blocks, each
    two blocks meet in one place and count their distances by bin. The bins that
    hold the median are counted again with more bits, three times at most, the
    last one without rest; earlier where at most 64 distances a vector are left.
    Time grows with the square of a recording; a task holds two blocks.

    Vectors of equal ``order`` are no pair. Those without label, or without
    embedding or with a null in it, have no distance, nor have two of different
    lengths; a zero vector is at distance 1.
    """
    named = [F.col(k).isNotNull() for k in keys]
    v = vectors.select(*keys, F.col(order).alias("i"), F.col(label).alias("s"), F.col("embedding").alias("e")).where(reduce(and_, named, F.col("i").isNotNull()))
    size = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("_a"), F.max("i").alias("_b")).where("_a < _b").drop("_a", "_b")
    usable = v.where(F.col("s").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull())).withColumnsRenamed({k: f"_{k}" for k in keys})
    state = ["at", "lo", "hi", "rank", "two", "to"]
    kinds = ", ".join(f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys)
    parts = 4 * vectors.sparkSession.sparkContext.defaultParallelism

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        told = {kind: {c: None if pd.isna(first[f"{c}{kind}"]) else int(first[f"{c}{kind}"]) for c in state} for kind in (0, 1)}
        rows = []
        if first["e"] is None:  # the medians are found
            for kind, t in told.items():
                if t["lo"] is not None:
                    bins = [(t["lo"], t["rank"] + 1 + (t["two"] if t["lo"] == t["hi"] else 0))] + [(t["hi"], 1)] * (t["lo"] != t["hi"])
                    rows += [(kind, 0, t["rank"], t["two"], *x) for x in bins]
        else:
            begun = pd.notna(first["at0"]) or pd.notna(first["at1"])
            ranges = {kind: (t["at"], t["lo"], t["hi"], t["to"]) for kind, t in told.items() if not begun or t["at"] is not None}
            size, codes = part["e"].map(len).to_numpy(), pd.factorize(part["s"])[0]
            rank, own = (part["i"] != part["i"].shift()).cumsum().to_numpy(), part["block"].to_numpy()
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = np.stack([np.asarray(e, np.float64) for e in part["e"].iloc[at]])
                with np.errstate(all="ignore"):
                    length = np.sqrt((x * x).sum(1, keepdims=True))
                    x = np.where(length > 0, x / np.where(length > 0, length, 1), x)
                    cut = 0 if first["u"] == first["w"] else int((own[at] == first["u"]).sum())
                    if first["u"] == first["w"] or 0 < cut < len(at):
                        for kind, (bins, n) in pair_bins(x, codes[at], rank[at], cut, ranges).items():
                            rows += [(kind, told[kind]["to"], told[kind]["rank"], told[kind]["two"], *y) for y in zip(bins.tolist(), n.tolist(), strict=True)]
        out = pd.DataFrame(rows, columns=["kind", "at", "rank", "two", "bin", "m"]).astype({"rank": "Int64", "two": "Int64"})
        for k in reversed([*keys, "n"]):
            out.insert(0, k, first[k])
        return out

    def narrowed(now: DataFrame, then: int) -> DataFrame:
        done = reduce(and_, [F.coalesce(F.col(f"at{k}") == 0, F.col(f"any{k}") == 0) for k in (0, 1)])
        met = now.withColumn("_done", done).join(usable, reduce(and_, [F.col(k) == F.col(f"_{k}") for k in keys], ~F.col("_done")), "left")
        blocks = F.ceil(F.col("n") / block)
        last = F.when(F.col("e").isNull(), F.lit(0).cast("bigint")).otherwise(blocks - 1)
        own = F.coalesce(F.pmod(F.xxhash64("i"), blocks), F.lit(0))
        units = met.withColumns({"block": own, "c": F.explode(F.sequence(F.lit(0).cast("bigint"), last))}).withColumns({"u": F.least("block", "c"), "w": F.greatest("block", "c")})
        units = units.select(*keys, "u", "w", "block", "n", "i", "s", "e", *[f"{c}{k}" for c in state for k in (0, 1)])
        told = ordered_fold(units, [*keys, "u", "w"], ["block", "i"], fold, f"{kinds}, n bigint, kind int, at int, rank bigint, two int, bin bigint, m bigint", parts)
        each = [*keys, "n", "kind", "at", "rank", "two"]
        bins = told.groupBy(*each, "bin").agg(F.sum("m").alias("m"))
        total = F.sum("m").over(over([*keys, "kind"]))
        bins = bins.withColumns({"rank": F.coalesce("rank", F.floor((total - 1) / 2)), "two": F.coalesce("two", (1 - total % 2).cast("int")), "upto": F.sum("m").over(upto([*keys, "kind"], ["bin"]))})
        low, high = F.col("upto") > F.col("rank"), F.col("upto") > F.col("rank") + F.col("two")
        found = bins.groupBy(*each).agg(F.coalesce(F.min(F.when(low, F.col("bin"))), F.max("bin")).alias("lo"), F.coalesce(F.min(F.when(high, F.col("bin"))), F.max("bin")).alias("hi"), F.coalesce(F.max(F.when(~low, F.col("upto"))), F.lit(0)).alias("under"), F.coalesce(F.min(F.when(high, F.col("upto"))), F.max("upto")).alias("upto"))
        found = found.withColumns({"rank": F.col("rank") - F.col("under"), "to": F.when(F.col("upto") - F.col("under") <= FEW * F.col("n"), 0).otherwise(then)})
        wide = found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("kind") == k, F.struct(*state))).alias(f"of{k}") for k in (0, 1)])
        return wide.select(*keys, "n", *[F.col(f"of{k}.{c}").alias(f"{c}{k}") for c in state for k in (0, 1)], *[F.col(f"of{k}").isNotNull().cast("int").alias(f"any{k}") for k in (0, 1)])

    start = F.when((F.col("n") - 1) / 2 <= FEW, 0).otherwise(BITS[0])
    nothing = {c: F.lit(None).cast("bigint") for c in state[:-1]} | {"to": start}
    found = size.select(*keys, "n", *[nothing[c].alias(f"{c}{k}") for c in state for k in (0, 1)], *[F.lit(1).alias(f"any{k}") for k in (0, 1)])
    for then in BITS[1:]:
        found = narrowed(found, then)
    found = narrowed(found, 0)

    def value(k: int) -> Column:
        lo, hi = F.col(f"lo{k}").cast("double"), F.col(f"hi{k}").cast("double")
        return F.when(hi >= NO_NUMBER * 2.0**53, F.lit(float("nan"))).otherwise((lo + hi) / 2.0**54)

    out = size.select(*keys).join(found.select(*keys, value(1).alias("intra"), value(0).alias("inter")), [*keys], "left")
    return out.withColumn("margin", F.col("inter") - F.col("intra"))


def pooled(runs: DataFrame, *, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Runs (wall_s, audio_s, score) by strategy: pooled real-time factor, median and mean score."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.sum("wall_s") / F.nullif(F.sum("audio_s"), F.lit(0.0))).alias("rtf"), F.median("score").alias("median_score"), F.avg("score").alias("mean_score"))


def against(rows: DataFrame, baseline: str, *, key: str = "strategy") -> DataFrame:
    """``rows`` (rtf, median_score) with ``speedup`` and ``delta`` against the baseline's row."""
    base = rows.where(F.col(key) == baseline).select(F.col("rtf").alias("_r"), F.col("median_score").alias("_s"))
    return rows.crossJoin(F.broadcast(base)).withColumns({"speedup": F.col("_r") / F.nullif(F.col("rtf"), F.lit(0.0)), "delta": F.col("median_score") - F.col("_s")}).drop("_r", "_s")  # one row


def constrained_best(rows: DataFrame, *, keys: tuple[str, ...] = (), quality: str = "quality", cost: str = "cost", limit: float, tie: str = "name") -> DataFrame:
    """The best row within the cost limit; where none is, the best of all."""
    order = [F.desc(F.col(cost) <= limit), F.desc(quality), tie]
    return rows.withColumn("_r", F.row_number().over(over(keys or [F.lit(0)], order))).where("_r = 1").drop("_r")


def pareto(rows: DataFrame, *, keys: tuple[str, ...], quality: str = "quality", cost: str = "cost") -> DataFrame:
    """Rows that no other of their group beats: none as good and as cheap and better in one.

    By sorting, not by comparing pairs: a row stays if all that are cheaper are
    worse and none of its own cost is better.
    """
    best = rows.groupBy(*keys, cost).agg(F.max(quality).alias("_q"))
    cheaper = F.max("_q").over(preceding(keys, [cost]))
    front = best.withColumn("_c", cheaper).where(F.col("_c").isNull() | (F.col("_q") > F.col("_c"))).select(*keys, cost, F.col("_q").alias(quality))
    return rows.join(front, [*keys, cost, quality], "left_semi")


def gate(rows: DataFrame, *, keys: tuple[str, ...] = (), max_der: float = 0.35, max_wer: float = 0.55) -> DataFrame:
    """Medians of clips (der, wer), and whether both are within bounds."""
    m = rows.groupBy(*keys).agg(F.median("der").alias("der"), F.median("wer").alias("wer"))
    return m.withColumn("passed", (F.col("der") <= max_der) & (F.col("wer") <= max_wer))


def throughput(runs: DataFrame, *, keys: tuple[str, ...] = ("engine",)) -> DataFrame:
    """Runs (wall_s, chars): least, median and longest time, characters a second."""
    return runs.groupBy(*keys).agg(F.min("wall_s").alias("min_s"), F.median("wall_s").alias("median_s"), F.max("wall_s").alias("max_s"), (F.sum("chars") / F.nullif(F.sum("wall_s"), F.lit(0.0))).alias("chars_per_s"))


def branches(source: DataFrame, named: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Several plans over one input in one result, each row named by its ``branch``."""
    out = None
    for name, plan in named.items():
        part = plan(source).withColumn("branch", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no branch")
    return out
