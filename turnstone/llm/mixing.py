"""Mixing sources to target weights by systematic sampling.

Every source gets a share of the output: ``weights[source]`` where given, else
its size to the power ``alpha`` (temperature), both made to sum to one. A
document's expected number of copies is that share of ``epochs`` times the
corpus, divided by its source's size. Within a source these expectations are
prefix-summed in a random but fixed order (md5 of the id), one random offset a
source is added, and a document is emitted once for each whole number that its
stretch of the sum crosses: floor or ceiling of its expectation, never else.

Sums are whole numbers of millionths, so any order of summation and any engine
gives the same rows. The sum over a source of any size is split: key ranges of
some ``RANGE_ROWS`` documents are summed first, then each range runs on from the
sum before it. How many ranges there are changes no result.

Defined results: a null source is a source of its own; a null or negative size
counts 0 characters; a source whose documents have no characters at all keeps
each document once; a null id takes its place by its text, and one without a
text either by the empty text; an empty text is like any other; texts are
compared whole whatever their length; repeated rows each take their own stretch
of the sum, those that tie in id and text one after the other in the order of a
hash of all their columns (but maps, which have none); an empty table gives an
empty table; other columns are passed on whatever their names, and a
``copy_col`` that is among them gets underscores before it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm.common import cut, fresh, quoted, table

#: Copies are counted in these parts of one copy.
PARTS = 1_000_000
ALPHA, EPOCHS, SEED = 0.5, 1.0, 17
RANGE_ROWS = 4096


def mix_sources(docs: DataFrame, *, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str = "n_chars", copy_col: str | None = "copy_no") -> DataFrame:
    """``docs`` with each row as often as it is drawn; ``copy_col`` (None: left out) numbers its copies from 1."""
    taken = {c.lower() for c in docs.columns}
    while copy_col is not None and copy_col.lower() in taken:
        copy_col = f"_{copy_col}"
    s, h, b, e, start, upto, n, size, w, k, tie, all_size, all_w = fresh([*docs.columns, copy_col or ""], "source", "order", "range", "expected", "start", "upto", "n", "size", "weight", "copy", "tie", "all_size", "all_weight")
    digits = max(1, min(16, math.ceil(math.log(max(1, docs.count() / RANGE_ROWS), 16))))
    text, hashed = F.col(quoted(text_col)), [F.col(quoted(f.name)) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumns(
        {
            s: F.coalesce(F.concat(F.lit("="), F.col(quoted(source_col)).cast("string")), F.lit("")),
            h: F.md5(F.coalesce(F.col(quoted(id_col)).cast("string"), F.concat(F.lit("text:"), text), F.lit(""))),
            tie: F.xxhash64(*hashed),
        }
    ).withColumn(b, F.substring(h, 1, digits))
    ranges = cut(keyed.groupBy(s, b).agg(F.count(F.lit(1)).alias(n), F.sum(F.greatest(F.coalesce(F.col(quoted(size_col)), F.lit(0)), F.lit(0))).cast("decimal(38,0)").alias(size)))
    sources = ranges.groupBy(s).agg(F.sum(size).cast("double").alias(size))
    share = F.pow(F.col(size), F.lit(float(alpha)))
    if weights is not None:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in (f"={kv[0]}", float(kv[1]))])[F.col(s)], F.lit(0.0)) if weights else F.lit(0.0)
    sources = sources.withColumn(w, F.when(F.col(size) > 0, share).otherwise(F.lit(0.0)))
    totals = sources.agg(F.sum(size).alias(all_size), F.sum(w).alias(all_w))  # one row
    expected = F.floor(F.round(F.col(w) * F.lit(float(epochs)) * F.col(all_size) / F.nullif(F.col(all_w), F.lit(0.0)) / F.nullif(F.col(size), F.lit(0.0)), 6) * PARTS + F.lit(0.5))
    sources = (
        sources.crossJoin(F.broadcast(totals))
        .withColumn(e, F.when(F.col(size) > 0, F.coalesce(expected, F.lit(0))).otherwise(F.lit(PARTS)).cast("bigint"))
        .withColumn(start, F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(s))), 1, 8), 16, 10).cast("bigint"), F.lit(PARTS)))
        .select(s, e, start)
    )
    before = Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(s, b, n).join(sources, s).withColumn(start, F.pmod(F.col(start) + F.col(e) * F.coalesce(F.sum(n).over(before), F.lit(0)).cast("decimal(38,0)"), F.lit(PARTS)).cast("bigint")).select(s, b, e, start)
    within = Window.partitionBy(s, b).orderBy(F.col(h), text, F.col(tie)).rowsBetween(Window.unboundedPreceding, 0)
    drawn = (
        keyed.join(offsets, [s, b])
        .withColumn(upto, F.col(start) + F.sum(e).over(within))
        .withColumn(n, F.floor(F.col(upto) / F.lit(PARTS)) - F.floor((F.col(upto) - F.col(e)) / F.lit(PARTS)))
        .where(F.col(n) > 0)
    )
    columns = [F.col(quoted(c)) for c in docs.columns]
    copies = drawn.select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))).alias(copy_col or k))
    return copies if copy_col else copies.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (
  SELECT *, coalesce('=' || source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || text, '')) AS h FROM documents
), z AS (
  SELECT s, CAST(sum(greatest(coalesce(n_chars, 0), 0)) AS DOUBLE) AS size FROM d GROUP BY s
), w AS (
  SELECT s, size, CASE WHEN size > 0 THEN pow(size, {ALPHA}) ELSE 0.0 END AS w FROM z
), e AS (
  SELECT s, CASE WHEN size > 0 THEN CAST(floor(round(w * {EPOCHS} * sum(size) OVER () / nullif(sum(w) OVER (), 0) / size, 6) * {PARTS} + 0.5) AS BIGINT) ELSE {PARTS} END AS e,
         CAST('0x' || substr(md5('{SEED}:' || s), 1, 8) AS BIGINT) % {PARTS} AS u
  FROM w
), p AS (
  SELECT d.*, e.e, e.u + sum(e.e) OVER (PARTITION BY s ORDER BY h, text ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN e USING (s)
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, CAST(floor(upto / {PARTS}.0) - floor((upto - e) / {PARTS}.0) AS BIGINT) + 1)) AS BIGINT) AS copy_no FROM p
"""
