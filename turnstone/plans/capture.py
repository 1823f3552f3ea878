"""Queries over sources, sinks, voice activity and end of turn, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.operators import eot, vad
from turnstone.operators.base import over
from turnstone.sinks import events as sinks
from turnstone.sources import formats, frames


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where there is one, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def windows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as scored windows: one recording a user, windows in the order of time."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), "ts", "event_id", F.col("value").alias("score"))
    return e.withColumn("seq", F.row_number().over(over(["rec_id"], ["ts", "event_id"])) - 1).select("rec_id", "seq", (F.col("seq").cast("bigint") * 512).alias("start_sample"), "score")


_WINDOWS = "WITH w AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, value AS score FROM events)"


def utterances_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as utterances: a second for 15 characters, one after another."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text", (F.char_length("text") * 200 / 3000.0).alias("dur"))
    t1 = F.sum(F.char_length("text")).over(over(["rec_id"], ["seq"]).rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("n", t1).select("rec_id", "seq", "speaker", "text", ((F.col("n") - F.char_length("text")) / 15.0).alias("t0"), (F.col("n") / 15.0).alias("t1"))


_UTTERANCES = """WITH n AS (SELECT conv_id AS rec_id, turn AS seq, role AS speaker, text, length(text) AS k, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations),
u AS (SELECT rec_id, seq, speaker, text, CAST(n - k AS DOUBLE) / 15.0 AS t0, CAST(n AS DOUBLE) / 15.0 AS t1 FROM n)"""


@query("array_framing", """
WITH r AS (SELECT vec_id AS rec_id, embedding AS pcm, unnest(range(0, len(embedding), 20)) AS a FROM embeddings)
SELECT rec_id, a // 20 AS seq, round(a / 1000.0, 6) AS t0, 20 AS n_samples, round(list_sum(list_transform(pcm[a + 1 : a + 20], lambda x: CAST(x AS DOUBLE))), 4) AS total,
       CAST(20 - len(pcm[a + 1 : a + 20]) AS INTEGER) AS padded FROM r""")
def array_framing(spark, sf_dir):
    r = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("embedding").alias("pcm"))
    f = frames.array_frames(r, sample_rate=1000)
    n = r.select(F.col("rec_id").alias("n_id"), F.size("pcm").alias("n"))
    total = F.aggregate("pcm", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return f.join(n, F.col("rec_id") == F.col("n_id")).select("rec_id", "seq", F.round("t0", 6).alias("t0"), F.size("pcm").alias("n_samples"), F.round(total, 4).alias("total"), F.greatest(F.lit(0), (F.col("seq").cast("int") + 1) * 20 - F.col("n")).alias("padded"))


@query("source_contract", """
SELECT o_orderkey AS rec_id, CASE WHEN o_orderkey % 7 = 0 THEN 'frames must be float32, got int16' WHEN 1 + o_orderkey % 5 // 4 <> 1 THEN 'frames must be mono'
  WHEN o_orderpriority = '1-URGENT' THEN 'rate must be 16000' WHEN 300 + o_orderkey % 40 > 320 THEN 'frames must have at most 320 samples' END AS violation FROM orders""")
def source_contract(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    v = frames.contract_violation(F.when(F.col("o_orderpriority") == "1-URGENT", 8000).otherwise(16000), 1 + F.floor(k % 5 / 4), 300 + k % 40, F.when(k % 7 == 0, "int16").otherwise("float32"))
    return o.select(k.alias("rec_id"), v.alias("violation"))


@query("duration_probe", "SELECT event_id, CASE WHEN value - 20 > 0 THEN round(value - 20, 6) END AS duration_s FROM events")
def duration_probe(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(frames.positive_duration(F.col("value") - 20), 6).alias("duration_s"))


@query("source_clip", """
WITH o AS (SELECT o_custkey AS rec_id, o_orderkey AS seq, o_totalprice AS dur, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders)
SELECT rec_id, seq, dur FROM o WHERE coalesce(b, 0) < 700000""")
def source_clip(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rec_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("dur"))
    return frames.clip(o, 700000)


def _rttm_lines(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    tag = F.when(F.col("event_id") % 11 == 0, "SPKR-INFO").otherwise("SPEAKER")
    start, dur = F.col("event_id").cast("string"), F.when(F.col("event_id") % 13 == 0, "n/a").otherwise((F.col("event_id") % 9).cast("string"))
    long = F.concat_ws(" ", tag, F.col("user_id").cast("string"), F.lit("1"), start, dur, F.lit("<NA> <NA>"), F.concat(F.lit("spk"), F.col("user_id") % 3), F.lit("<NA>"), F.col("event_type"))
    short = F.concat_ws(" ", start, F.col("event_id") + F.col("event_id") % 9 - 3, F.concat(F.lit("spk"), F.col("user_id") % 3))
    return e.select("event_id", F.when(F.col("event_id") % 2 == 0, long).otherwise(short).alias("line"))


@query("rttm_parse", """
SELECT event_id, CAST(event_id AS DOUBLE) AS start, CAST(event_id + event_id % 9 AS DOUBLE) AS "end", 'spk' || user_id % 3 AS speaker, event_type AS word
FROM events WHERE event_id % 2 = 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0""")
def rttm_parse(spark, sf_dir):
    return formats.rttm_words(_rttm_lines(spark, sf_dir))


@query("rttm_turns", """
SELECT event_id, CAST(event_id AS DOUBLE) AS start, CAST(event_id + event_id % 9 AS DOUBLE) AS "end", 'spk' || user_id % 3 AS speaker
FROM events WHERE event_id % 2 = 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0""")
def rttm_turns(spark, sf_dir):
    lines = _rttm_lines(spark, sf_dir)
    return formats.rttm_turns(lines.withColumn("line", F.regexp_replace("line", " <NA> [a-z_]+$", "")))


@query("diarizer_lines", """
SELECT event_id, CAST(event_id AS DOUBLE) AS start, CAST(event_id + event_id % 9 - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 3 END AS DOUBLE) AS "end", 'spk' || user_id % 3 AS speaker
FROM events WHERE CASE WHEN event_id % 2 = 0 THEN event_id % 11 <> 0 AND event_id % 13 <> 0 ELSE event_id % 9 > 3 END""")
def diarizer_lines(spark, sf_dir):
    return formats.diarizer_lines(_rttm_lines(spark, sf_dir))


@query("caption_text", """
WITH c AS (SELECT conv_id AS rec_id, turn, text, turn * 7 + 5 AS e FROM conversations), k AS (SELECT *, max(CASE WHEN e > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS late FROM c)
SELECT rec_id, coalesce(string_agg(regexp_replace(trim(text), '<[^>]+>', '', 'g'), ' ' ORDER BY turn) FILTER (WHERE late = 0 AND trim(text) <> ''), '') AS text FROM k GROUP BY rec_id""")
def caption_text(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), "turn", F.regexp_replace("text", "[\r\n]", "\u0001").alias("text"))
    stamp = lambda s: F.concat(F.lit("00:"), F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(".000"))
    cue = F.concat(stamp(F.col("turn") * 7), F.lit(" --> "), stamp(F.col("turn") * 7 + 5))
    body = c.select("rec_id", F.explode(F.array(F.struct((F.col("turn") * 3 + 1).alias("line_no"), cue.alias("line")), F.struct((F.col("turn") * 3 + 2).alias("line_no"), F.concat(F.lit("<c.white>"), F.col("text"), F.lit("</c>")).alias("line")), F.struct((F.col("turn") * 3 + 3).alias("line_no"), F.lit("").alias("line")))).alias("l")).select("rec_id", "l.line_no", "l.line")
    head = c.select("rec_id").distinct().select("rec_id", F.lit(-1).cast("bigint").alias("line_no"), F.lit("WEBVTT").alias("line"))
    out = formats.caption_text(head.union(body), max_s=20)
    return out.select("rec_id", F.translate("text", "\u0001", "\n").alias("text"))


@query("event_jsonl", """SELECT CAST(to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type}) AS VARCHAR) AS value FROM events""")
def event_jsonl(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.array(F.col("value")).alias("pcm"))
    return sinks.jsonl(e)


@query("human_line", _UTTERANCES + """ SELECT rec_id, seq, printf('[%7.2fs -> %7.2fs  %s]  %s', rec_id / 8.0::DOUBLE + 0.125, (rec_id + seq) / 8.0::DOUBLE + 0.675, speaker, text) AS line FROM u""")
def human_line(spark, sf_dir):
    """Times that end in half a hundredth, exactly (.125) and nearly (.675)."""
    k = F.col("rec_id")
    return utterances_of(spark, sf_dir).select("rec_id", "seq", sinks.human_line(k / 8 + 0.125, (k + F.col("seq")) / 8 + 0.675, F.col("speaker"), F.col("text")).alias("line"))


@query("event_response", """SELECT user_id AS rec_id, list(event_id || ':' || event_type ORDER BY ts, event_id) AS events, count(*) AS count FROM events GROUP BY user_id""")
def event_response(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), "ts", "event_id", "event_type")
    out = sinks.response(e, ["ts", "event_id"], ["rec_id"])
    return out.withColumn("events", F.transform("events", lambda x: F.concat_ws(":", x["event_id"], x["event_type"])))


@query("event_merge", """
SELECT conv_id AS rec_id, turn AS seq, role AS speaker, text, NULL AS summary, 'utterance' AS event_type FROM conversations WHERE role <> 'system'
UNION ALL SELECT conv_id, turn, NULL, NULL, text, 'summary' FROM conversations WHERE role = 'system'""")
def event_merge(spark, sf_dir):
    return _two_streams(spark, sf_dir)


def _two_streams(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("seq"), "role", "text")
    said = c.where("role <> 'system'").withColumnRenamed("role", "speaker")
    return sinks.merged(said, c.where("role = 'system'").select("rec_id", "seq", F.col("text").alias("summary")))


@query("speaker_palette", """
WITH f AS (SELECT o_custkey AS rec_id, o_orderpriority || o_orderstatus AS speaker, min(o_orderkey) AS first_seq FROM orders GROUP BY 1, 2)
SELECT rec_id, speaker, first_seq, CAST((row_number() OVER (PARTITION BY rec_id ORDER BY first_seq) - 1) % 8 AS INTEGER) AS colour FROM f""")
def speaker_palette(spark, sf_dir):
    return sinks.palette(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rec_id"), F.concat("o_orderpriority", "o_orderstatus").alias("speaker"), F.col("o_orderkey").alias("seq")))


@query("last_summary", """
SELECT conv_id AS rec_id, arg_max(text, turn) FILTER (WHERE role = 'system' AND text <> '') AS summary, count(*) FILTER (WHERE role <> 'system') AS utterances FROM conversations GROUP BY 1""")
def last_summary(spark, sf_dir):
    return sinks.final_summary(_two_streams(spark, sf_dir))


@query("transcript_json", """SELECT doc_id, CAST(to_json({'text': source, 'language': CASE WHEN doc_id % 3 = 0 THEN 'auto' ELSE lang END}) AS VARCHAR) AS body FROM documents""")
def transcript_json(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", sinks.transcript(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.lit("auto"), F.col("source")).alias("body"))


@query("window_scores", _WINDOWS + """, f AS (SELECT vec_id AS rec_id, embedding AS pcm, unnest(range(0, len(embedding) - 23, 24)) AS a FROM embeddings)
SELECT rec_id, a // 24 AS seq, a AS start_sample, round(list_sum(list_transform(pcm[a + 1 : a + 24], lambda x: CAST(x AS DOUBLE) * x)), 5) AS energy FROM f""")
def window_scores(spark, sf_dir):
    r = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec_id"), F.col("embedding").alias("pcm"))
    w = vad.rechunk(frames.array_frames(r, sample_rate=1000, frame_ms=16), window=24)
    return w.select("rec_id", "seq", "start_sample", F.round(F.aggregate("pcm", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 5).alias("energy"))


@query("vad_segments", _WINDOWS + """, v AS (SELECT *, seq * 512 AS a, seq * 512 + 512 AS b, (max(seq) OVER (PARTITION BY rec_id) + 1) * 512.0 AS total FROM w),
g AS (SELECT *, lag(b) OVER (PARTITION BY rec_id ORDER BY a) AS p FROM v WHERE score >= 60),
i AS (SELECT *, sum(CASE WHEN (a - p) / 16.0 >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM g),
r AS (SELECT rec_id, island, min(a) AS a, max(b) AS b, max(total) AS total FROM i GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN lead(island) OVER (PARTITION BY rec_id ORDER BY island) IS NULL AND (total - b) / 16.0 < 150 THEN total ELSE b END AS stop FROM r),
t AS (SELECT rec_id, greatest(0, CAST(a AS DOUBLE) / 16000 - 0.02) AS t0, CAST(stop AS DOUBLE) / 16000 + 0.02 AS t1 FROM o)
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY t0) - 1 AS seg_id, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM t WHERE (t1 - t0) * 1000 >= 75""")
def vad_segments(spark, sf_dir):
    s = vad.voiced_segments(windows_of(spark, sf_dir), threshold=60, min_silence_ms=150, min_speech_ms=75, edge_pad_ms=20)
    return s.select("rec_id", "seg_id", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


@query("mask_runs", _WINDOWS + """, c AS (SELECT *, score >= 20 AS voiced, sum(CASE WHEN (score >= 20) IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS i
  FROM (SELECT *, lag(score >= 20) OVER (PARTITION BY rec_id ORDER BY seq) AS p FROM w))
SELECT rec_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM c WHERE voiced GROUP BY rec_id, i HAVING count(*) >= 5""")
def mask_runs(spark, sf_dir):
    w = windows_of(spark, sf_dir).withColumns({"voiced": F.col("score") >= 20, "seq": F.col("seq").cast("bigint")})
    return vad.mask_runs(w, least=5)


@query("eot_verdict", """
WITH a AS (SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN ' YES, done' WHEN 1 THEN 'no' WHEN 2 THEN 'know yes' WHEN 3 THEN 'Well: yes.' WHEN 4 THEN 'it is surely yes' END AS answer FROM documents),
h AS (SELECT doc_id, text, answer, substr(lower(trim(answer)), 1, 10) AS head FROM a)
SELECT doc_id, CASE WHEN trim(text) = '' OR answer IS NULL THEN true ELSE instr(head, 'yes') > 0 AND instr(substr(head, 1, instr(head, 'yes') + 2), 'no') = 0 END AS complete FROM h""")
def eot_verdict(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    answer = F.when(k == 0, " YES, done").when(k == 1, "no").when(k == 2, "know yes").when(k == 3, "Well: yes.").when(k == 4, "it is surely yes")
    return d.select("doc_id", eot.verdict(answer, F.col("text")).alias("complete"))


def _segments(spark, sf_dir):
    """Orders of a customer as segments on a time line."""
    o = read(spark, sf_dir, "orders")
    seq = (F.row_number().over(over(["o_custkey"], ["o_orderkey"])) - 1).cast("bigint")
    o = o.select(F.col("o_custkey").alias("rec_id"), seq.alias("seq"), "o_orderkey")
    t0 = F.col("seq") * 3.0
    return o.select("rec_id", "seq", t0.alias("t0"), (t0 + 0.25 + (F.col("o_orderkey") % 11) * 0.125).alias("t1"), (F.col("o_orderkey") % 3 == 0).alias("complete"))


_SEGMENTS = """o AS (SELECT o_custkey AS rec_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, o_orderkey FROM orders),
s AS (SELECT rec_id, seq, seq * 3.0::DOUBLE AS t0, seq * 3.0::DOUBLE + 0.25 + (o_orderkey % 11) * 0.125 AS t1, o_orderkey % 3 = 0 AS complete FROM o)"""


@query("eot_merge", "WITH RECURSIVE " + _SEGMENTS + """,
f(rec_id, seq, held_first, held_t0, out_first, out_t0, out_t1, next_t1) AS (
  SELECT rec_id, seq, CASE WHEN (t1 - t0) * 1000 >= 800 OR complete THEN NULL ELSE seq END, CASE WHEN (t1 - t0) * 1000 >= 800 OR complete THEN NULL ELSE t0 END,
         CASE WHEN (t1 - t0) * 1000 >= 800 OR complete THEN seq END, t0, t1, t1 FROM s WHERE seq = 0
  UNION ALL
  SELECT s.rec_id, s.seq,
    CASE WHEN f.held_first IS NULL THEN CASE WHEN (s.t1 - s.t0) * 1000 >= 800 OR s.complete THEN NULL ELSE s.seq END WHEN s.t1 - f.held_t0 >= 4 OR s.complete THEN NULL ELSE f.held_first END,
    CASE WHEN f.held_first IS NULL THEN CASE WHEN (s.t1 - s.t0) * 1000 >= 800 OR s.complete THEN NULL ELSE s.t0 END WHEN s.t1 - f.held_t0 >= 4 OR s.complete THEN NULL ELSE f.held_t0 END,
    CASE WHEN f.held_first IS NULL THEN CASE WHEN (s.t1 - s.t0) * 1000 >= 800 OR s.complete THEN s.seq END WHEN s.t1 - f.held_t0 >= 4 OR s.complete THEN f.held_first END,
    coalesce(f.held_t0, s.t0), s.t1, s.t1
  FROM f JOIN s ON s.rec_id = f.rec_id AND s.seq = f.seq + 1)
SELECT rec_id, out_first AS first_seq, seq AS last_seq, out_t0 AS t0, out_t1 AS t1 FROM f WHERE out_first IS NOT NULL
UNION ALL SELECT rec_id, held_first, seq, held_t0, next_t1 FROM f WHERE held_first IS NOT NULL AND seq = (SELECT max(seq) FROM s WHERE s.rec_id = f.rec_id)""")
def eot_merge(spark, sf_dir):
    return eot.merge_turns(_segments(spark, sf_dir))


@query("false_cut", r"""
WITH t AS (SELECT source AS rec_id, regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\r\n]+$', ''), '^[ \t\r\n]+', '') AS t FROM documents)
SELECT rec_id, count(*) AS n, count(*) FILTER (WHERE t = '') AS n_empty, count(*) FILTER (WHERE t <> '' AND right(t, 1) NOT IN ('.', '?', '!')) AS n_false,
       round(count(*) FILTER (WHERE t <> '' AND right(t, 1) NOT IN ('.', '?', '!')) / CAST(greatest(1, count(*) - count(*) FILTER (WHERE t = '')) AS DOUBLE), 6) AS rate FROM t GROUP BY 1""")
def false_cut(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("rec_id"), "text")
    return eot.false_cuts(d, keys=("rec_id",)).withColumn("rate", F.round("rate", 6))
