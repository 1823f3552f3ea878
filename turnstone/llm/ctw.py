"""Code length of documents by context-tree weighting, trained on the whole corpus.

A byte is eight binary decisions; each decision has its own tree over the bytes
before it, the latest first, down to ``depth``. Every node of a tree counts the
zeros and ones that followed its context anywhere in the corpus and gives the
Krichevsky-Trofimov estimate of them; a node's weighted probability is half its
own estimate and half the product of its children's, so all depths are mixed
(Willems, Shtarkov & Tjalkens). Having seen the corpus, a node's weight is the
posterior half of its own estimate, and the probability of the next bit follows
down the path. A document's score is the code length of its bytes, in bits,
each by the path of its context. The counts are of all documents, the scored one
among them: it is the cost of a document to who knows the corpus.

The counts are those of the distinct (depth + 1)-grams. Tasks count their
block's grams; a shuffle on the gram adds them up, and one of the distinct
grams on the two latest context bytes brings every subtree below depth 2 into
one task (256 ** (depth - 1) grams at most, a bound that the alphabet sets and
no corpus moves); the 256 x 255 + 255 nodes above it are collected and sent
back. Costs of grams go back to just the blocks that hold them, next to their
documents, so nothing that grows with the corpus is broadcast, and each document
is scored in a single pass over its block's costs. A block is a split of an
input file (``spark.sql.files.maxPartitionBytes``); rows that come from no file
are dealt to blocks of some ``BLOCK_ROWS`` by a hash.

Defined results: null and empty texts have 0 bytes, 0 bits and a null rate;
before a text's first byte stand zero bytes; texts are read whole whatever their
length; repeated rows count as often as they are there and have one score each;
nothing is ranked, so nothing ties; null ids are passed on; an empty table gives
an empty table; only the id and text columns are read, so other columns can have
any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.common import cut, quoted, table
from turnstone.llm.textkit import raw, slices

DEPTH = 4
#: Grams of a subtree batch that are worked on at once, at least; a subtree is never cut.
CHUNK = 150_000
#: Rows that are packed by block at once.
PACKED = 400_000
BLOCK_ROWS = 20_000
_U = np.uint64
_LN2 = math.log(2)
_KNOWN = 1 << 16
_half = np.concatenate([[0.5 * math.log(math.pi)], 0.5 * math.log(math.pi) + np.cumsum(np.log(np.arange(_KNOWN - 1) + 0.5))])  # ln Gamma(k + 1/2)
_whole = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _KNOWN)))])  # ln Gamma(k + 1)


def _ln_gamma(k: np.ndarray, known: np.ndarray, plus: float) -> np.ndarray:
    small = k < _KNOWN
    out = known[np.where(small, k, 0).astype(np.int64)]
    if not small.all():
        x = k[~small] + plus
        out[~small] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _ln_gamma(zeros, _half, 0.5) + _ln_gamma(ones, _half, 0.5) - _ln_gamma(zeros + ones, _whole, 1.0) - math.log(math.pi)


def grams(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte: its ``depth`` bytes of context, the latest in the highest place, and the byte; and where texts begin."""
    data, offsets = raw(texts)
    lengths = np.diff(offsets)
    padded = np.zeros(len(data) + depth * len(lengths), np.uint8)
    at = np.arange(len(data)) + np.repeat(depth * np.arange(1, len(lengths) + 1), lengths)
    padded[at] = data
    key = data.astype(np.uint64)
    for k in range(1, depth + 1):
        key |= padded[at - k].astype(np.uint64) << _U(8 * (depth + 1 - k))
    return key, offsets


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(n, first) if len(first) else n)


class Subtrees:
    """The trees of some grams below depth 2: sorted distinct ``keys`` with counts ``n``, all grams of each two-byte context."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.symbol = (keys & _U(255)).astype(np.int64)
        shift = np.arange(8)
        self.bit = (self.symbol[:, None] >> (7 - shift)) & 1
        self.place = (1 << shift) | (self.symbol[:, None] >> (8 - shift))  # node of the byte's binary tree
        node = ((keys >> _U(8)) << _U(8))[:, None] | self.place.astype(np.uint64)
        node, index = np.unique(node.ravel(), return_inverse=True)
        bit, count = self.bit.ravel(), np.repeat(n.astype(np.float64), 8)
        ones = np.bincount(index, count * bit, len(node))
        zeros = np.bincount(index, count, len(node)) - ones
        self.levels = [(index, zeros, ones, np.ones(len(node)))]
        weighted = kt(zeros, ones)
        for _ in range(depth - 2):
            node, index = np.unique((node >> _U(16) << _U(8)) | (node & _U(255)), return_inverse=True)
            zeros, ones, below = (np.bincount(index, x, len(node)) for x in (zeros, ones, weighted))
            own = kt(zeros, ones)
            weighted = np.logaddexp(own, below) - _LN2
            self.levels.append((index, zeros, ones, np.exp(own - _LN2 - weighted)))
        self.node, self.weighted = node, weighted

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Latest byte, place in the byte's tree, zeros, ones and weighted ln probability of the nodes at depth 2."""
        _, zeros, ones, _ = self.levels[-1]
        return (self.node >> _U(16)).astype(np.int64), (self.node & _U(255)).astype(np.int64), zeros, ones, self.weighted

    def costs(self, keys: np.ndarray, depth: int, upper: list[np.ndarray]) -> np.ndarray:
        """Bits that each gram's byte costs."""
        p, index = None, np.arange(self.bit.size)
        bit = self.bit.ravel()
        for way, zeros, ones, own in self.levels:
            index = way[index]
            estimate = (np.where(bit == 1, ones[index], zeros[index]) + 0.5) / (zeros[index] + ones[index] + 1)
            p = estimate if p is None else own[index] * estimate + (1 - own[index]) * p
        latest = np.repeat((keys >> _U(8 * depth)).astype(np.int64), 8)
        place = self.place.ravel()
        for zeros, ones, own in (upper[:3], upper[3:]):
            at = (latest, place) if zeros.ndim == 2 else place
            estimate = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
            p = own[at] * estimate + (1 - own[at]) * p
        return -np.log2(p).reshape(-1, 8).sum(1)


def upper_nodes(rows: list) -> list[np.ndarray]:
    """Rows (latest byte, place, zeros, ones, product of children) of depth 1 -> counts and weights of depths 1 and 0."""
    zeros, ones, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for latest, place, z, o, w in rows:
        zeros[latest, place], ones[latest, place], below[latest, place] = z, o, w
    own = kt(zeros.ravel(), ones.ravel()).reshape(256, 256)
    weighted = np.where(zeros + ones > 0, np.logaddexp(own, below) - _LN2, 0.0)
    out = [zeros, ones, np.exp(own - _LN2 - weighted)]
    zeros, ones, below = zeros.sum(0), ones.sum(0), weighted.sum(0)
    own = kt(zeros, ones)
    return [*out, zeros, ones, np.exp(own - np.logaddexp(own, below))]


def _count(depth: int):
    """(block, id, text) -> (key, block, n), each gram of a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for whole in batches:
            blocks = whole.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for batch in slices(whole.slice(a, b - a), 2):
                    mine = held.setdefault(int(blocks[a]), [])
                    mine.append(np.unique(grams(batch.column(2), depth)[0], return_counts=True))
                    while len(mine) > 1 and len(mine[-2][0]) < 2 * len(mine[-1][0]):
                        y, x = mine.pop(), mine.pop()
                        mine.append(summed(*(np.concatenate(z) for z in zip(x, y, strict=True))))
        for block, parts in held.items():
            keys, n = summed(*(np.concatenate(z) for z in zip(*parts, strict=True)))
            for lo in range(0, len(keys), 100_000):
                k = keys[lo : lo + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), block)), pa.array(n[lo : lo + 100_000].astype(np.int64))], names=["key", "block", "n"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, n) in runs that hold all of their two-byte contexts; rows come sorted by key, each key once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= CHUNK:
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            prefix = key >> _U(8 * (depth - 1))
            end = int(np.searchsorted(prefix, prefix[-1], "left"))
            if end:
                yield key[:end], n[:end]
            held = [(key[end:], n[end:])]
            size = len(key) - end if end else 0  # a context that is larger than a chunk grows on
    if held and sum(len(h[0]) for h in held):
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, block, n), all rows of a key in this task and next to each other -> (key, n)."""
    last: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def out(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])

    for batch in batches:
        k, n = summed(np.concatenate([last[0], batch.column(0).to_numpy()]), np.concatenate([last[1], batch.column(2).to_numpy()]))
        if len(k):
            yield out(k[:-1], n[:-1])
            last = (k[-1:], n[-1:])
    yield out(*last)


def _tops(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _chunks(batches, depth):
            t = Subtrees(key, n, depth).top()
            yield pa.RecordBatch.from_arrays([pa.array(t[0].astype(np.int32)), pa.array(t[1].astype(np.int32)), *(pa.array(x) for x in t[2:])], names=["latest", "place", "zeros", "ones", "below"])

    return run


def _costs(depth: int, upper: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _chunks(batches, depth):
            bits = Subtrees(key, n, depth).costs(key, depth, upper).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bits)], names=["key", "cost"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, cost) -> the costs of each block as bytes, one row for some ``PACKED`` rows."""

    def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, key, cost = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in range(3))
        order = np.argsort(block, kind="stable")
        block, key, cost = block[order], key[order], cost[order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(block))
        packs = [(key[a:b].tobytes(), cost[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(block[edges[:-1]]), pa.array(np.zeros(len(packs), np.int32)), pa.nulls(len(packs), pa.int64()), pa.nulls(len(packs), pa.string()), pa.array([p[0] for p in packs], pa.binary()), pa.array([p[1] for p in packs], pa.binary())],
            names=["block", "kind", "id", "text", "keys", "costs"],
        )

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PACKED:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


def _score(depth: int):
    """Rows of a block follow each other: packs of costs, then documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: list[tuple[np.ndarray, np.ndarray]] = []
        current, ready = None, False
        keys = costs = np.zeros(0)
        for whole in batches:
            blocks, kinds = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]), [True]])) if len(blocks) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = whole.slice(a, b - a)
                if blocks[a] != current:
                    current, packs, ready = blocks[a], [], False
                if kinds[a] == 0:
                    packs += [(np.frombuffer(k, np.uint64), np.frombuffer(c, np.float32)) for k, c in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)]
                    continue
                if not ready:
                    keys, costs = (np.concatenate([p[k] for p in packs] or [np.zeros(0, (np.uint64, np.float32)[k])]) for k in (0, 1))
                    order = np.argsort(keys)
                    keys, costs, packs, ready = keys[order], costs[order].astype(np.float64), [], True
                for batch in slices(part, 3):
                    g, offsets = grams(batch.column(3), depth)
                    at = np.searchsorted(keys, g)
                    if len(g) and (at.max() >= len(keys) or (keys[at] != g).any()):
                        raise ValueError("a gram that was not counted: the documents changed between passes")
                    run_sum = np.concatenate([[0.0], np.cumsum(costs[at])]) if len(g) else np.zeros(1)
                    size = np.diff(offsets)
                    total = run_sum[offsets[1:]] - run_sum[offsets[:-1]]
                    rate = pa.array(np.round(total / np.maximum(size, 1), 4), mask=size == 0)
                    yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(size), pa.array(np.round(total, 2)), rate], names=["doc_id", "n_bytes", "code_bits", "bits_per_byte"])

    return run


def code_lengths(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``doc_id, n_bytes, code_bits, bits_per_byte`` of every document. ``depth``: 2 to 6 bytes of context."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    number, text = F.col(quoted(id_col)).cast("bigint"), F.col(quoted(text_col))
    # the same in both passes
    block = F.when(F.input_file_name() == "", F.pmod(F.xxhash64(number, text), F.lit(-(-docs.count() // BLOCK_ROWS) or 1))).otherwise(F.xxhash64(F.input_file_name(), F.input_file_block_start()))
    plain = docs.select(block.alias("block"), number.alias("id"), text.alias("text"))
    counted = plain.mapInArrow(_count(depth), "key bigint, block bigint, n bigint")
    counts = cut(counted.repartition("key").sortWithinPartitions("key"))  # a gram has one row a block, however frequent it is
    trees = cut(counts.mapInArrow(_totals, "key bigint, n bigint").repartition(F.shiftright("key", 8 * (depth - 1))).sortWithinPartitions("key"))  # each gram once
    tops = trees.mapInArrow(_tops(depth), "latest int, place int, zeros double, ones double, below double")
    upper = upper_nodes(tops.groupBy("latest", "place").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect())  # 65,280 rows at most
    costs = trees.mapInArrow(_costs(depth, upper), "key bigint, cost float")
    costs = counts.select("block", "key").join(costs, "key").select("block", "key", "cost").mapInArrow(_pack, "block bigint, kind int, id bigint, text string, keys binary, costs binary")
    texts = plain.select("block", F.lit(1).alias("kind"), "id", "text", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("costs"))
    return costs.union(texts).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_score(depth), "doc_id bigint, n_bytes bigint, code_bits double, bits_per_byte double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_lengths(table(spark, sf_dir, "documents"))
