"""Exact top-k by inner product for every row as a query, by norm-bucketed retrieval.

Vectors are put in buckets by length, longest first. With theta(q) a lower
bound of a query's k-th best product, a bucket with longest vector l can only
hold results whose cosine with q reaches theta(q) / (|q| l), its *local
threshold* (LEMP, Teflioudi, Gemulla & Mykytiuk). Over 1 the bucket is passed
over. Else the threshold chooses, for each query and bucket:

* high (``COORDINATE`` and up): coordinate pruning. On the query's ``FOCUS``
  largest coordinates a unit vector with that cosine must lie in
  q_f t +- sqrt((1 - t^2) (1 - q_f^2)); what lies outside is dropped.
* lower: length pruning. Only the bucket's vectors of length theta(q) / |q| and
  more remain, a prefix, since it is sorted.

What remains is verified by its product, in double precision.

Blocks of queries (the buckets again) and buckets meet in a grid of g x g cells,
each block in the g cells of a row, each bucket in the g cells of a column.
Columns take buckets in turn, so each has its share of the longest. A cell holds
its buckets and passes its blocks over them, longest first; theta starts from
the ``head`` longest buckets of all and rises with each bucket. A cell gives its
k best of a query, a last ranking joins the g cells of its row. So vectors are
sent g times (g = n / ``CELL``, or what keeps all cores busy if that is more),
not once for each pair of buckets. Exact search of all rows stays quadratic in
the end: on vectors of one length without structure no bound prunes much.

Results are ranked by product rounded to 6 places, then by id; a row is not its
own result. Bounds are loosened by 1e-5, so rounding loses nothing.

Defined results: null or empty vectors, vectors with null or non-finite
elements, of another dimension than most (the smaller of two as frequent), and
null ids are left out on both sides; a zero vector has the product 0 with all;
repeated rows are results of each other where their ids differ, rows of one id
count once, with the least vector; with k or fewer others all are results; an
empty table gives an empty table; only the id and vector columns are read, so
other columns can have any name. There are no texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm.common import cut, quoted, table

K, BUCKET, HEAD = 10, 2048, 2
COORDINATE, FOCUS, SLACK = 0.8, 4, 1e-5
#: Vectors of a cell, on either side.
CELL = 65_536


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, id, vector) -> one row a bucket: ids, vectors and lengths as bytes."""
    held: list[pa.RecordBatch] = []

    def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids = t.column(1).to_numpy()
        x = t.column(2).chunk(0).flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        order = np.lexsort((ids, -length))
        x, ids, length = np.ascontiguousarray(x[order]), ids[order], length[order]
        return pa.RecordBatch.from_arrays([pa.array([t.column(0)[0].as_py()], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["bucket", "ids", "vectors"])

    for batch in batches:
        b = batch.column(0).to_numpy()
        edges = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b)) if len(b) else [0]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != int(b[lo]):
                yield out(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield out(held)


def _open(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    x = np.frombuffer(vectors, np.float64).reshape(len(i), -1)
    return i, x, np.sqrt(np.einsum("ij,ij->i", x, x))


def candidates(q: np.ndarray, ql: np.ndarray, theta: np.ndarray, x: np.ndarray, xl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) index pairs of a query block and a bucket (longest first) that may reach theta."""
    theta = theta - SLACK
    longest = xl[0]
    reach = ql * longest
    local = np.where(theta <= 0, 0.0, theta / np.where(reach > 0, reach, 1e-300))
    by_length = np.flatnonzero((local < COORDINATE) & (local <= 1))
    left, right = [], []
    if len(by_length):
        need = np.where(theta[by_length] > 0, theta[by_length] / np.where(ql[by_length] > 0, ql[by_length], 1e-300), -1.0)
        prefix = np.searchsorted(-xl, -need, "right")
        n = int(prefix.max())
        if n:
            products = q[by_length].astype(np.float32) @ x[:n].astype(np.float32).T
            slack = 1e-5 * (1 + reach[by_length])  # single precision
            a, b = np.nonzero((products >= (theta[by_length] - slack)[:, None]) & (np.arange(n) < prefix[:, None]))
            left.append(by_length[a])
            right.append(b)
    unit = None
    for k in np.flatnonzero((local >= COORDINATE) & (local <= 1)):
        if unit is None:
            unit = x / np.where(xl > 0, xl, 1.0)[:, None]
        u, t = q[k] / ql[k], local[k] - 1e-9
        focus = np.argsort(-np.abs(u))[:FOCUS]
        mid, half = u[focus] * t, np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0.0, 1 - u[focus] ** 2)) + 1e-9
        # the region of a cosine of t or more reaches to 1 where the coordinate's own cosine does
        low = np.where(-u[focus] >= t, -1.0, mid - half)
        high = np.where(u[focus] >= t, 1.0, mid + half)
        inside = np.flatnonzero(((unit[:, focus] >= low) & (unit[:, focus] <= high)).all(1))
        left.append(np.full(len(inside), k))
        right.append(inside)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def best(qi: np.ndarray, q: np.ndarray, ql: np.ndarray, theta: np.ndarray, xi: np.ndarray, x: np.ndarray, xl: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, product) of the k best verified candidates of each query."""
    a, b = candidates(q, ql, theta, x, xl)
    keep = qi[a] != xi[b]
    a, b = a[keep], b[keep]
    score = np.empty(len(a))
    for lo in range(0, len(a), 200_000):
        score[lo : lo + 200_000] = np.einsum("ij,ij->i", q[a[lo : lo + 200_000]], x[b[lo : lo + 200_000]])
    score = np.round(score, 6) + 0.0
    order = np.lexsort((xi[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, a, "left")
    top = np.arange(len(a)) - first < k
    return a[top], xi[b[top]], score[top]


def _first_bounds(k: int, head: list[tuple[bytes, bytes]]):
    """Adds theta, from the longest buckets, to each query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [_open(*h) for h in head]
        for batch in batches:
            for r in range(batch.num_rows):
                qi, q, _ = _open(batch.column(1)[r].as_py(), batch.column(2)[r].as_py())
                kept = np.full((len(qi), k), -np.inf)
                for xi, x, _ in opened:
                    s = q @ x.T
                    s[qi[:, None] == xi[None, :]] = -np.inf
                    kept = np.sort(np.concatenate([kept, s], 1), axis=1)[:, -k:]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in range(3)), pa.array([kept[:, 0].tobytes()], pa.binary())], names=["bucket", "ids", "vectors", "theta"])

    return run


def _search(k: int):
    """Rows of a cell follow each other, buckets (longest first) before query blocks -> the k best of each query in the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                at, kind, ids, vectors, theta = batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), *(batch.column(c)[r].as_py() for c in (3, 4, 5))
                if at != cell:
                    cell, held = at, []
                if kind == 0:
                    held.append(_open(ids, vectors))
                    continue
                qi, q, ql = _open(ids, vectors)
                bound = np.frombuffer(theta, np.float64).copy()
                top, found = np.full((len(qi), 0), -np.inf), np.zeros((len(qi), 0), np.int64)
                for xi, x, xl in held:
                    if not (bound - SLACK <= ql * xl[0]).any():
                        continue
                    a, ids_of, score = best(qi, q, ql, bound, xi, x, xl, k)
                    nth = np.arange(len(a)) - np.searchsorted(a, a, "left")
                    more, more_ids = np.full((len(qi), k), -np.inf), np.full((len(qi), k), np.iinfo(np.int64).max)
                    more[a, nth], more_ids[a, nth] = score, ids_of
                    top, found = np.concatenate([top, more], 1), np.concatenate([found, more_ids], 1)
                    order = np.lexsort((found, -top), axis=1)[:, :k]
                    top, found = np.take_along_axis(top, order, 1), np.take_along_axis(found, order, 1)
                    bound = np.maximum(bound, top[:, -1])
                a, b = np.nonzero(top > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(found[a, b]), pa.array(top[a, b])], names=["query_id", "vec_id", "product"])

    return run


def top_k(vectors: DataFrame, *, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", bucket: int = BUCKET, head: int = HEAD) -> DataFrame:
    """``query_id, rank, vec_id, product``: the k largest products of every row with the others."""
    v = F.col(quoted(vector_col))
    rows = vectors.select(F.col(quoted(id_col)).cast("bigint").alias("id"), v.cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, product double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes[0]["d"]).groupBy("id").agg(F.min("v").alias("v"))
    length = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)), 6)
    parts = max(1, -(-sizes[0]["n"] // bucket))
    spread = rows.repartitionByRange(parts, length.desc(), "id").sortWithinPartitions(length.desc(), "id")
    packed = spread.select((F.spark_partition_id().cast("bigint") * (1 << 32) + F.floor((F.monotonically_increasing_id() % (1 << 33)) / bucket)).alias("bucket"), "id", "v")
    buckets = cut(packed.mapInArrow(_pack, "bucket bigint, ids binary, vectors binary"))
    longest = [(bytes(r["ids"]), bytes(r["vectors"])) for r in buckets.orderBy("bucket").limit(head).collect()]  # a fixed number of buckets of bounded size
    queries = buckets.mapInArrow(_first_bounds(k, longest), "bucket bigint, ids binary, vectors binary, theta binary")
    count = buckets.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    g = max(1, min(count, max(math.ceil(sizes[0]["n"] / CELL), math.ceil(math.sqrt(2 * cores)))))
    along = F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    turn = F.pmod(F.shiftright("bucket", 32) + F.col("bucket") % (1 << 32), F.lit(g)).cast("int")
    held = buckets.select(along.alias("r"), "bucket", "ids", "vectors").select((F.col("r") * g + turn).alias("cell"), F.lit(0).alias("kind"), "bucket", "ids", "vectors", F.lit(None).cast("binary").alias("theta"))
    asked = queries.select(along.alias("c"), "bucket", "ids", "vectors", "theta").select((turn * g + F.col("c")).alias("cell"), F.lit(1).alias("kind"), "bucket", "ids", "vectors", "theta")
    cells = held.union(asked).repartitionByRange(g * g, "cell").sortWithinPartitions("cell", "kind", "bucket")
    found = cells.mapInArrow(_search(k), "query_id bigint, vec_id bigint, product double")
    order = Window.partitionBy("query_id").orderBy(F.desc("product"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "product")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_inner_product(a.e, b.e), 6) AS product FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY product DESC, vec_id) AS INTEGER) AS rank, vec_id, product FROM p)
SELECT * FROM r WHERE rank <= {K}
"""
