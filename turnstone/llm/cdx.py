"""Capture index of a web archive, built by external merging.

Each input partition becomes a run: its captures sorted by URL key, timestamp
and id, written to the shared folder. Key ranges are then dealt to tasks, each
of some ``STRETCH`` captures at most, and each task merges its stretch of all
runs with a loser tree (k-way, one comparison a level for each row), numbering
captures and comparing bodies as they come. The stretches, one file each, are
in global order. Where a stretch begins and how many captures of its first URL
stand before it is two rows a stretch; joining them moves no capture, so the
result is in order as well, and a URL with any number of captures can be cut
anywhere.

The URL key is the host with its labels reversed, then path and sorted query:
scheme, user, port, leading ``www``, fragment, trailing slash and ``utm_``
parameters don't count.

Defined results: a null or blank URL has the key ``''``; a null timestamp comes
before all others of its key, a null id before other ids; captures that tie in
key, time and id come in the order of their body's digest, then of their URL;
repeated rows are captures of their own, next to each other; URLs and bodies
are read whole whatever their length (a capture whose key, time and id all tie
with more than ``STRETCH`` others is merged with them in one task); a null body
has no digest and is never a revisit; an empty table gives an empty table. Only
the named columns are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm.common import cut, quoted, table

OUT = "part int, row bigint, id bigint, url string, url_key string, captured_at bigint, digest string, nth bigint, again boolean, final boolean"
#: Captures that a task merges at once.
STRETCH = 200_000
_FIELDS = ("id", "url", "url_key", "captured_at", "digest")


class LoserTree:
    """Merges sorted lists; each step replays one path of ``log2 k`` comparisons from the winner's leaf."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [r for r in runs if r]
        self.k = len(self.runs)
        self.at = [0] * self.k
        self.head: list[tuple | None] = [r[0] for r in self.runs]
        self.loser = [-1] * max(1, self.k)
        self.winner = self._build() if self.k else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return x is not None
        return x < y if x != y else a < b

    def _build(self) -> int:
        won = [0] * (2 * self.k)
        won[self.k :] = range(self.k)
        for node in range(self.k - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.loser[node] = (a, b) if self._less(a, b) else (b, a)
        return won[1] if self.k > 1 else 0

    def __iter__(self) -> Iterator[tuple]:
        head, runs, at, loser, k = self.head, self.runs, self.at, self.loser, self.k
        w = self.winner
        while k and head[w] is not None:
            yield head[w]
            at[w] += 1
            head[w] = runs[w][at[w]] if at[w] < len(runs[w]) else None
            node = (w + k) >> 1
            while node:
                if self._less(loser[node], w):
                    w, loser[node] = loser[node], w
                node >>= 1
        self.winner = w


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One stretch of keys: its rows by run, merged. Of a run's rows those in order form a list; a step back begins another."""
    runs: dict[int, list[list[tuple]]] = {}
    for batch in batches:
        c = {f: batch.column(batch.schema.get_field_index(f)).to_pylist() for f in (*_FIELDS, "run")}
        for run, key, ts, i, digest, url in zip(c["run"], c["url_key"], c["captured_at"], c["id"], c["digest"], c["url"], strict=True):
            row = (key.encode(), ts is not None, ts or 0, i is not None, i or 0, digest or "", url or "", url is not None, digest is not None)
            lists = runs.setdefault(run, [[]])
            if lists[-1] and row < lists[-1][-1]:
                lists.append([])
            lists[-1].append(row)
    part, n, nth, rows = TaskContext.get().partitionId(), 0, 0, []
    numbers: list[tuple[int, bool]] = []

    def out(last: bool) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(rows), pa.int32()),
                pa.array(range(n - len(rows), n), pa.int64()),
                pa.array([v if ok else None for ok, v in zip(cols[3], cols[4], strict=True)], pa.int64()),
                pa.array([v if ok else None for ok, v in zip(cols[7], cols[6], strict=True)], pa.string()),
                pa.array([v.decode() for v in cols[0]], pa.string()),
                pa.array([v if ok else None for ok, v in zip(cols[1], cols[2], strict=True)], pa.int64()),
                pa.array([v if ok else None for ok, v in zip(cols[8], cols[5], strict=True)], pa.string()),
                pa.array([k for k, _ in numbers], pa.int64()),
                pa.array([r for _, r in numbers], pa.bool_()),
                pa.array([last and k == len(rows) - 1 for k in range(len(rows))], pa.bool_()),
            ],
            names=[c.split()[0] for c in OUT.split(", ")],
        )

    before = None
    for row in LoserTree([x for lists in runs.values() for x in lists]):
        if len(rows) == 20_000:
            yield out(False)
            rows, numbers = [], []
        same = before is not None and before[0] == row[0]
        nth = nth + 1 if same else 1
        numbers.append((nth, same and row[8] and before[8] and before[5] == row[5]))
        rows.append(row)
        before = row
        n += 1
    if rows:
        yield out(True)


def url_key(url: str) -> str:
    """Spark SQL for the key of the column ``url``."""
    rest = f"regexp_replace(regexp_replace(trim(coalesce({url}, '')), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({rest}, '^([^/?]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www[0-9]*[.]', '')"
    path = f"regexp_replace(regexp_extract({rest}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    args = f"array_join(array_sort(filter(split(regexp_extract({rest}, '(?s)^[^?]*[?](.*)$', 1), '&'), p -> p <> '' AND NOT startswith(p, 'utm_'))), '&')"
    return f"concat(array_join(reverse(split({host}, '[.]')), ','), CASE WHEN {host} = '' THEN '' ELSE ')' END, {path}, CASE WHEN {args} = '' THEN '' ELSE concat('?', {args}) END)"


def capture_index(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", captured_at: str) -> DataFrame:
    """All captures in the order of URL key, time and id. ``captured_at``: SQL for seconds since 1970.

    ``position`` counts from 1 over the index, ``capture_no`` within the key;
    ``revisit`` marks a body equal to that of the key's capture before.
    """
    keyed = pages.select(
        F.col(quoted(id_col)).cast("bigint").alias("id"),
        F.col(quoted(url_col)).alias("url"),
        F.expr(url_key(quoted(url_col))).alias("url_key"),
        F.expr(captured_at).cast("bigint").alias("captured_at"),
        F.md5(F.col(quoted(body_col))).alias("digest"),
        F.spark_partition_id().alias("run"),
    )
    key = [F.col("url_key"), F.asc_nulls_first("captured_at"), F.asc_nulls_first("id")]
    order = [*key, F.coalesce("digest", F.lit("")), F.coalesce("url", F.lit(""))]
    runs = cut(keyed.sortWithinPartitions(*order))  # the runs; the bodies are read once
    stretches = max(1, -(-runs.count() // STRETCH), pages.sparkSession.sparkContext.defaultParallelism)
    merged = cut(runs.repartitionByRange(stretches, *key).mapInArrow(_merge, OUT))  # a stretch is a file, in order
    lasts = merged.where("final").select("part", "url_key", F.col("nth").alias("n"), (F.col("row") + 1).alias("rows"), "digest")
    firsts = merged.where("row = nth - 1").groupBy("part", "url_key").agg(F.max("nth").alias("n")).withColumn("first", F.lit(True))
    # two rows a stretch from here on
    ends = lasts.join(firsts.select("part", "url_key", "first"), ["part", "url_key"], "left").select("part", "url_key", "n", "digest", F.coalesce("first", F.lit(False)).alias("first"))
    edges = ends.union(firsts.join(lasts, ["part", "url_key"], "left_anti").select("part", "url_key", "n", F.lit(None).cast("string"), F.lit(True)))
    chain = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(F.col("part").alias("c_part"), F.col("url_key").alias("c_key"), "first", F.coalesce(F.sum("n").over(chain), F.lit(0)).alias("before"), F.last("digest").over(chain).alias("c_digest")).where("first").drop("first")
    starts = lasts.select(F.col("part").alias("s_part"), F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    full = merged.join(F.broadcast(starts.join(carried, F.col("s_part") == F.col("c_part"))), F.col("part") == F.col("s_part"))  # one row a stretch: 500,000 for 10^11 captures
    own = F.col("url_key") == F.col("c_key")
    return full.select(
        (F.col("start") + F.col("row") + 1).alias("position"),
        "url_key",
        "captured_at",
        F.col("id").alias("page_id"),
        "url",
        "digest",
        (F.when(own, F.col("before")).otherwise(F.lit(0)) + F.col("nth")).alias("capture_no"),
        F.coalesce(F.when(F.col("nth") > 1, F.col("again")).when(own, F.col("digest") == F.col("c_digest")), F.lit(False)).alias("revisit"),
    )


#: ``pages`` has no fetch time; this one follows from the id, out of step with it.
CAPTURED_AT = "1577836800 + pmod(page_id * 48271, 94608000)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index(table(spark, sf_dir, "pages"), captured_at=CAPTURED_AT)


SQL = r"""
WITH a AS (
  SELECT page_id, url, md5(html) AS digest, 1577836800 + (page_id * 48271) % 94608000 AS captured_at,
         regexp_replace(regexp_replace(trim(coalesce(url, '')), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages
), b AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www[0-9]*[.]', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '(?s)^[^?]*[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS args
  FROM a
), c AS (
  SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN host = '' THEN '' ELSE ')' END || path || CASE WHEN coalesce(args, '') = '' THEN '' ELSE '?' || args END AS url_key FROM b
)
SELECT row_number() OVER (ORDER BY url_key, captured_at NULLS FIRST, page_id NULLS FIRST, digest, url) AS "position", url_key, captured_at, page_id, url, digest,
       row_number() OVER w AS capture_no, coalesce(digest = lag(digest) OVER w, false) AS revisit
FROM c WINDOW w AS (PARTITION BY url_key ORDER BY captured_at NULLS FIRST, page_id NULLS FIRST, digest, url)
"""
