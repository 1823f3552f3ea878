"""Queries over speakers, packing and re-attribution, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.operators import asr, diarize, eot
from turnstone.functions.columns import unit
from turnstone.operators.base import over, preceding
from turnstone.plans.capture import read

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _embedded(spark, sf_dir, parts: int = 20):
    """``embeddings`` as segments of ``parts`` recordings; the given label speaks."""
    e = read(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    return e.select((k % parts).alias("rec_id"), k.alias("seq"), (k * 1.0).alias("t0"), (k + 0.25 + (k % 8) * 0.125).alias("t1"), F.concat(F.lit("S"), F.col("label")).alias("speaker"), "embedding")


_UNIT = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v)"


@query("short_segment_gate", "SELECT vec_id AS seq, CASE WHEN (0.25 + (vec_id % 8) * 0.125) * 1000 < 500 THEN 'S?' ELSE 'S' || label END AS speaker FROM embeddings")
def short_segment_gate(spark, sf_dir):
    s = _embedded(spark, sf_dir)
    return s.select("seq", F.when(diarize.too_short(F.col("t0"), F.col("t1")), diarize.UNKNOWN).otherwise(F.col("speaker")).alias("speaker"))


@query("unit_norm", "WITH " + _UNIT + " SELECT vec_id, round(list_sum(e), 5) AS total, round(list_inner_product(e, e), 5) AS norm2 FROM u")
def unit_norm(spark, sf_dir):
    u = read(spark, sf_dir, "embeddings").select("vec_id", unit(F.col("embedding")).alias("e"))
    return u.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x), 5).alias("norm2"))


@query("speaker_centroids", "WITH " + _UNIT + """, x AS (SELECT vec_id % 20 AS rec_id, 'S' || label AS speaker, unnest(range(0, 64)) AS dim, unnest(e) AS x FROM u),
m AS (SELECT rec_id, speaker, dim, avg(x) AS x, count(*) AS n FROM x GROUP BY ALL), l AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY rec_id, speaker)) AS len FROM m)
SELECT rec_id, speaker, CAST(dim AS INTEGER) AS dim, round(x / len, 6) AS x, n FROM l""")
def speaker_centroids(spark, sf_dir):
    c = diarize.centroids(_embedded(spark, sf_dir))
    return c.select("rec_id", "speaker", F.posexplode("centroid").alias("dim", "x"), "n").withColumn("x", F.round("x", 6))


@query("online_cluster")
def online_cluster(spark, sf_dir):
    return diarize.online_cluster(_embedded(spark, sf_dir), join_threshold=0.8).select("rec_id", "seq", "speaker")


@query("single_linkage")
def single_linkage(spark, sf_dir):
    return diarize.single_linkage(diarize.centroids(_embedded(spark, sf_dir)), 0.85)


@query("prune_assign", "WITH " + _UNIT + """, s AS (SELECT vec_id % 20 AS rec_id, vec_id AS seq, 'S' || label AS speaker, e FROM u),
x AS (SELECT rec_id, speaker, unnest(range(0, 64)) AS dim, unnest(e) AS x FROM s), m AS (SELECT rec_id, speaker, dim, avg(x) AS x, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT rec_id, speaker, list(x ORDER BY dim) AS c, max(n) AS n FROM m GROUP BY 1, 2), g AS (SELECT rec_id, speaker, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c, n FROM c),
p AS (SELECT s.rec_id, s.seq, b.speaker, row_number() OVER (PARTITION BY s.rec_id, s.seq ORDER BY round(list_inner_product(s.e, b.c), 9) DESC, length(b.speaker), b.speaker) AS r
      FROM s JOIN g a USING (rec_id, speaker) JOIN g b ON b.rec_id = s.rec_id WHERE a.n < 3 AND b.n >= 3)
SELECT s.rec_id, s.seq, coalesce(p.speaker, s.speaker) AS speaker FROM s LEFT JOIN p ON p.rec_id = s.rec_id AND p.seq = s.seq AND p.r = 1""")
def prune_assign(spark, sf_dir):
    return diarize.prune(_embedded(spark, sf_dir), min_cluster=3).select("rec_id", "seq", "speaker")


@query("compact_relabel", """
WITH s AS (SELECT vec_id % 20 AS rec_id, vec_id AS seq, CASE WHEN vec_id % 7 = 0 THEN 'S?' ELSE 'S' || label END AS speaker FROM embeddings), f AS (SELECT *, min(seq) OVER (PARTITION BY rec_id, speaker) AS f FROM s)
SELECT rec_id, seq, CASE WHEN speaker = 'S?' THEN 'S?' ELSE 'S' || (dense_rank() OVER (PARTITION BY rec_id, speaker = 'S?' ORDER BY f) - 1) END AS speaker FROM f""")
def compact_relabel(spark, sf_dir):
    s = _embedded(spark, sf_dir).withColumn("speaker", F.when(F.col("seq") % 7 == 0, diarize.UNKNOWN).otherwise(F.col("speaker")))
    return diarize.compact_relabel(s).select("rec_id", "seq", "speaker")


@query("chunk_plan", """
WITH d AS (SELECT o_orderkey AS rec_id, CAST(o_totalprice AS DOUBLE) AS dur FROM orders), n AS (SELECT *, CASE WHEN dur <= 60000.001 THEN 0 ELSE CAST(ceil((dur - 60000) / 50000.0) AS INTEGER) END AS more FROM d),
c AS (SELECT rec_id, dur, CAST(unnest(range(0, more + 1)) AS INTEGER) AS chunk FROM n)
SELECT rec_id, chunk, chunk * 50000.0::DOUBLE AS t0, round(CASE WHEN dur <= 60000.001 THEN dur ELSE least(dur, chunk * 50000.0 + 60000) END, 4) AS t1 FROM c""")
def chunk_plan(spark, sf_dir):
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), F.col("o_totalprice").alias("dur"))
    return diarize.chunk_plan(d, ideal_s=60000.0, overlap_s=10000.0).withColumn("t1", F.round("t1", 4))


def _spans(spark, sf_dir):
    """Lines of a supplier as spans: a speaker for each flag, times in days."""
    li = read(spark, sf_dir, "lineitem")
    t0 = F.datediff("l_shipdate", F.lit("1990-01-01")).cast("double")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select(F.col("l_suppkey").alias("rec_id"), seq.alias("seq"), t0.alias("t0"), (t0 + F.col("l_quantity")).alias("t1"), F.col("l_returnflag").alias("speaker"), F.col("l_linestatus").alias("word"))


_SPANS = "s AS (SELECT l_suppkey AS rec_id, l_orderkey * 10 + l_linenumber AS seq, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t0, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) + l_quantity AS t1, l_returnflag AS speaker, l_linestatus AS word FROM lineitem)"
_RUNS = _SPANS + """, p AS (SELECT *, lag(speaker) OVER (PARTITION BY rec_id ORDER BY t0, seq) AS p FROM s),
r AS (SELECT *, sum(CASE WHEN speaker IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY t0, seq ROWS UNBOUNDED PRECEDING) AS run FROM p),
m AS (SELECT *, max(t1) OVER (PARTITION BY rec_id, run ORDER BY t0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r)"""


@query("interval_merge", "WITH " + _RUNS + """, i AS (SELECT *, sum(CASE WHEN t0 > reach + 1e-3 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, run ORDER BY t0, seq ROWS UNBOUNDED PRECEDING) AS part FROM m)
SELECT rec_id, any_value(speaker) AS speaker, min(t0) AS t0, max(t1) AS t1, count(*) AS n FROM i GROUP BY rec_id, run, part""")
def interval_merge(spark, sf_dir):
    return diarize.merge_spans(_spans(spark, sf_dir))


@query("slice_bounds", """
SELECT vec_id AS seq, greatest(0, CAST(round_even(vec_id / 32.0 * 16, 0) AS BIGINT)) AS a, least(400, CAST(round_even((vec_id + 3) / 32.0 * 16, 0) AS BIGINT)) AS b FROM embeddings
WHERE least(400, CAST(round_even((vec_id + 3) / 32.0 * 16, 0) AS BIGINT)) > greatest(0, CAST(round_even(vec_id / 32.0 * 16, 0) AS BIGINT))""")
def slice_bounds(spark, sf_dir):
    k = F.col("vec_id")
    a, b = diarize.slice_bounds(k / 32.0, (k + 3) / 32.0, F.lit(400).cast("bigint"), 16)
    return read(spark, sf_dir, "embeddings").select(k.alias("seq"), a.alias("a"), b.alias("b")).where("b > a")


@query("turns", "WITH " + _RUNS + " SELECT rec_id, any_value(speaker) AS speaker, min(t0) AS t0, max(t1) AS t1, count(*) AS n, string_agg(word, ' ' ORDER BY t0, seq) AS text FROM m GROUP BY rec_id, run")
def turns(spark, sf_dir):
    return diarize.turns(_spans(spark, sf_dir), text="word")


@query("bridged_turns", "WITH " + _RUNS + """, i AS (SELECT *, sum(CASE WHEN t0 - reach > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, run ORDER BY t0, seq ROWS UNBOUNDED PRECEDING) AS part FROM m)
SELECT rec_id, any_value(speaker) AS speaker, min(t0) AS t0, max(t1) AS t1, count(*) AS n, string_agg(word, ' ' ORDER BY t0, seq) AS text FROM i GROUP BY rec_id, run, part""")
def bridged_turns(spark, sf_dir):
    return diarize.turns(_spans(spark, sf_dir), gap_s=2, text="word")


@query("bridged_turns_by_speaker", "WITH " + _SPANS + """, m AS (SELECT *, max(t1) OVER (PARTITION BY rec_id, speaker ORDER BY t0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN t0 - reach > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, speaker ORDER BY t0, seq ROWS UNBOUNDED PRECEDING) AS part FROM m)
SELECT rec_id, speaker, min(t0) AS t0, max(t1) AS t1, count(*) AS n FROM i GROUP BY rec_id, speaker, part""")
def bridged_turns_by_speaker(spark, sf_dir):
    return diarize.turns(_spans(spark, sf_dir), gap_s=2, per_speaker=True)


@query("overlap_attribution", "WITH " + _SPANS + """, g AS (SELECT n_nationkey AS rec_id, unnest(range(0, 80)) AS seg_id FROM nation), t AS (SELECT rec_id, seg_id, seg_id * 40.0::DOUBLE + rec_id AS t0, seg_id * 40.0::DOUBLE + rec_id + 25 AS t1 FROM g),
o AS (SELECT t.rec_id, t.seg_id, s.speaker, sum(least(t.t1, s.t1) - greatest(t.t0, s.t0)) AS overlap FROM t JOIN s ON t.rec_id = s.rec_id AND t.t0 < s.t1 AND s.t0 < t.t1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_id ORDER BY overlap DESC, speaker) AS r FROM o) SELECT CAST(rec_id AS BIGINT) AS rec_id, CAST(seg_id AS INTEGER) AS seg_id, speaker, overlap FROM r WHERE r = 1""")
def overlap_attribution(spark, sf_dir):
    k = F.col("n_nationkey")
    g = read(spark, sf_dir, "nation").select(k.cast("bigint").alias("rec_id"), F.explode(F.sequence(F.lit(0), F.lit(79))).alias("seg_id"))
    t = g.select("rec_id", "seg_id", (F.col("seg_id") * 40.0 + F.col("rec_id")).alias("t0"), (F.col("seg_id") * 40.0 + F.col("rec_id") + 25).alias("t1"))
    return diarize.dominant_speaker(t, _spans(spark, sf_dir), bucket_s=100.0)


@query("stitch_chunks")
def stitch_chunks(spark, sf_dir):
    s = _embedded(spark, sf_dir).select("rec_id", (F.col("seq") % 3).alias("chunk"), F.col("seq").cast("string").alias("local"), "embedding")
    return diarize.stitch(s, threshold=0.9)


def _durations(spark, sf_dir):
    """Lines of an order as segments: centiseconds from the quantity."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("rec_id"), (F.row_number().over(over(["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])) - 1).cast("bigint").alias("seq"), (F.col("l_quantity") / 5 + 0.0137).alias("dur"), F.col("l_returnflag").alias("speaker"), "l_partkey")


_DURATIONS = """d AS MATERIALIZED (SELECT l_suppkey AS rec_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS seq, l_quantity / 5 + 0.0137::DOUBLE AS dur, l_returnflag AS speaker, l_partkey FROM lineitem),
l AS (SELECT *, lag(speaker) OVER (PARTITION BY rec_id ORDER BY seq) AS before FROM d)"""


def _packed(brk: str) -> str:
    fits = f"f.filled > 0 AND (f.filled + 0.1::DOUBLE + l.dur > 24{brk})"
    return f"""{_DURATIONS}, f(rec_id, seq, dur, chunk, filled) AS (SELECT rec_id, seq, dur, 0, dur FROM l WHERE seq = 0 UNION ALL
SELECT l.rec_id, l.seq, l.dur, CASE WHEN {fits} THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN {fits} THEN l.dur ELSE f.filled + (CASE WHEN f.filled > 0 THEN 0.1::DOUBLE ELSE 0 END + l.dur) END
FROM f JOIN l ON l.rec_id = f.rec_id AND l.seq = f.seq + 1)"""


@query("greedy_pack", "WITH RECURSIVE " + _packed("") + " SELECT rec_id, seq, round(dur, 4) AS dur, CAST(chunk AS INTEGER) AS chunk FROM f")
def greedy_pack(spark, sf_dir):
    return asr.pack(_durations(spark, sf_dir)).withColumn("dur", F.round("dur", 4))


@query("speaker_pack", "WITH RECURSIVE " + _packed(" OR l.speaker <> l.before") + " SELECT rec_id, seq, round(dur, 4) AS dur, CAST(chunk AS INTEGER) AS chunk FROM f")
def speaker_pack(spark, sf_dir):
    return asr.pack(_durations(spark, sf_dir), speaker="speaker").withColumn("dur", F.round("dur", 4))


def _chunked(spark, sf_dir):
    d = _durations(spark, sf_dir)
    at = F.sum("dur").over(preceding(["rec_id"], ["seq"]))
    return asr.local_windows(d.withColumns({"chunk": F.floor(F.col("seq") / 4).cast("int"), "seg_t0": F.coalesce(at, F.lit(0.0))}))


_CHUNKED = _DURATIONS + """, w AS (SELECT *, CAST(seq // 4 AS INTEGER) AS chunk, coalesce(sum(dur) OVER (PARTITION BY rec_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg_t0 FROM d),
x AS MATERIALIZED (SELECT *, coalesce(sum(dur + 0.1::DOUBLE) OVER (PARTITION BY rec_id, chunk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM w)"""


@query("chunk_windows", "WITH " + _CHUNKED + " SELECT rec_id, seq, chunk, round(lo, 4) AS lo, round(lo + dur, 4) AS hi FROM x")
def chunk_windows(spark, sf_dir):
    return _chunked(spark, sf_dir).select("rec_id", "seq", "chunk", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def _phrases(spark, sf_dir):
    d = _durations(spark, sf_dir).where("seq % 2 = 0")
    t0 = (F.col("l_partkey") % 200) / 8 + 0.03
    return d.select("rec_id", F.floor(F.col("seq") / 4).cast("int").alias("chunk"), F.col("seq").alias("phrase_id"), t0.alias("t0"), (t0 + 0.5).alias("t1"), F.concat(F.lit(" p"), "seq", F.lit(" ")).alias("text"), F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("speaker")).alias("language"))


_PHRASES = _CHUNKED + """, ph AS MATERIALIZED (SELECT rec_id, CAST(seq // 4 AS INTEGER) AS chunk, seq AS phrase_id, (l_partkey % 200) / 8.0::DOUBLE + 0.03 AS t0, (l_partkey % 200) / 8.0::DOUBLE + 0.03 + 0.5 AS t1, 'p' || seq AS text, CASE WHEN seq % 3 <> 0 THEN speaker END AS language FROM d WHERE seq % 2 = 0),
j AS (SELECT ph.*, x.seq, x.lo, x.lo + x.dur AS hi, x.seg_t0, (ph.t0 + ph.t1) / 2 AS m FROM ph JOIN x ON x.rec_id = ph.rec_id AND x.chunk = ph.chunk),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rec_id, chunk, phrase_id ORDER BY CASE WHEN m >= lo AND m <= hi THEN -1 ELSE least(abs(m - lo), abs(m - hi)) END, seq) AS r FROM j)"""


@query("phrase_assign", "WITH " + _PHRASES + " SELECT rec_id, phrase_id, seq, round(seg_t0 + greatest(0, t0 - lo), 4) AS at0, round(seg_t0 + greatest(0, t1 - lo), 4) AS at1 FROM k WHERE r = 1")
def phrase_assign(spark, sf_dir):
    a = asr.assign_phrases(_phrases(spark, sf_dir), _chunked(spark, sf_dir))
    return a.select("rec_id", "phrase_id", "seq", F.round("at0", 4).alias("at0"), F.round("at1", 4).alias("at1"))


@query("utterances", "WITH " + _PHRASES + """, g AS (SELECT rec_id, seq, string_agg(text, ' ' ORDER BY phrase_id) AS text, count(*) AS n, first(language ORDER BY phrase_id) FILTER (WHERE language IS NOT NULL) AS language FROM k WHERE r = 1 GROUP BY 1, 2)
SELECT d.rec_id, d.seq, coalesce(g.text, '') AS text, CAST(coalesce(g.n, 0) AS INTEGER) AS n_words, g.language FROM d LEFT JOIN g ON g.rec_id = d.rec_id AND g.seq = d.seq""")
def utterances(spark, sf_dir):
    c = _chunked(spark, sf_dir)
    u = asr.utterances(c.select("rec_id", "seq"), asr.assign_phrases(_phrases(spark, sf_dir), c))
    return u.select("rec_id", "seq", "text", F.size("words").alias("n_words"), "language")


@query("segment_gate", "SELECT event_id, CASE WHEN value < 250 THEN '' ELSE event_type END AS text FROM events WHERE value < 250 OR event_type <> 'error'")
def segment_gate(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    model = F.when(F.col("event_type") != "error", F.col("event_type"))
    return e.select("event_id", asr.gated(F.lit(0.0), F.col("value") / 1000, model).alias("text")).where("text IS NOT NULL")


@query("joined_sound", """
WITH p AS (SELECT a.vec_id AS seq, a.embedding AS a, b.embedding AS b, greatest(0, CAST(round_even((a.vec_id % 5 - 1) / 8.0 * 20, 0) AS INTEGER)) AS gap FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT seq, CAST(len(a) + gap + len(b) AS INTEGER) AS n, gap, round(b[1], 5) AS after, round(a[len(a)], 5) AS before FROM p""")
def joined_sound(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")
    pairs = e.select("seq", F.col("embedding").alias("a")).join(e.select((F.col("seq") - 1).alias("seq"), F.col("embedding").alias("b")), "seq")
    joined = pairs.select("seq", F.size("a").alias("na"), F.size("b").alias("nb"), eot.joined_sound(F.col("a"), F.col("b"), (F.col("seq") % 5 - 1) / 8, 20).alias("x"))
    gap = F.size("x") - F.col("na") - F.col("nb")
    at = lambda k: F.round(F.element_at("x", k.cast("int")).cast("double"), 5)
    return joined.select("seq", F.size("x").alias("n"), gap.alias("gap"), at(F.col("na") + gap + 1).alias("after"), at(F.col("na")).alias("before"))
