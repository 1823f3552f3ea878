"""Near-duplicate documents: SimHash fingerprints in an LSH forest.

A text's fingerprint has 256 bits, each the sign of a sum of +1 or -1 over its
distinct words. Near duplicates are texts whose fingerprints differ in at most
``max_distance`` bits; groups are what such pairs connect; the group's least id
stays. Pairs of more than ``sure`` bits are verified on the texts as well: their
sets of words and word pairs must have a Jaccard similarity of ``min_jaccard``
or more.

The forest has several tries, each over its own random permutation of the bits;
in batch form a trie is the sorted order of its permuted fingerprints, and its
nodes at depth p are the runs that share p bits. Depth adapts to density: from
the ``floor``, the greatest depth that any search uses, a search climbs to
shorter prefixes as long as the node there holds ``LEAF`` fingerprints at most,
so it ends high where fingerprints are few and stays deep where they crowd. The
floor is where an average node holds one to two ``LEAF``; there are as many
tries as make two fingerprints at ``max_distance`` bits meet at the floor in at
least one of them with probability ``target``, so recall holds at the limit for
any number of fingerprints n, and closer pairs and those of sparse nodes are
found more surely. Tries grow as n to the power 0.31 at the default limit (14
at 50,000, 90 at 15 million); a lower ``max_distance`` needs fewer. There is no
cap on tries, nodes or pairs.

All pairs of a node are verified on all 256 bits. In a crowded node close
fingerprints are gathered around pivots first: those of one pivot are linked
without being compared with each other, and what is far from a pivot by the
triangle inequality is far from all around it, so a group of any size costs
linear time. A node's links are cut down to a spanning star of each group,
which keeps groups as they are.

Equal fingerprints are one entry of the forest, so thousands of exact copies
cost one row. Groups of entries are closed by alternating large-star and
small-star rounds, each written to the shared folder.

Defined results: a null text, an empty text and a text without a word (letters,
digits, anything beyond ASCII) have no fingerprint and stay, as groups of their
own; of repeated rows (same id and text) one stays, any of them if other
columns differ; texts of one id are told apart by their hash, the lesser stays;
sums that tie give the bit 0; a null id comes after all ids; texts are read
whole whatever their length; an empty table gives an empty table; other columns
are passed on whatever their names. Letters of ASCII and Latin-1 are compared
without case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.llm.common import cut, fresh, quoted, table
from turnstone.llm.textkit import Words, mix, slices

BITS, WORDS64 = 256, 4
#: Bits that near duplicates may differ in. Up to SURE_DISTANCE a pair needs no other proof; beyond, its texts' feature sets must have this Jaccard similarity.
MAX_DISTANCE, SURE_DISTANCE, MIN_JACCARD = 48, 36, 0.5
#: Chance that a pair at MAX_DISTANCE meets in some trie; fingerprints that a node holds; levels that a search can climb.
TARGET_RECALL, LEAF, CLIMB = 0.95, 128, 3
#: Bits of a trie that are kept in order; fingerprints of a node from which pivots are used, and the bits around a pivot.
KEY_BITS, CROWDED, AROUND = 48, 512, 18
SEED = 20240607

_LANES = np.zeros(256, np.uint64)  # byte -> eight 8-bit lanes, one a bit
for _b in range(256):
    _LANES[_b] = int.from_bytes(bytes(_b >> k & 1 for k in range(8)), "little")


def features(texts: pa.Array, pairs: bool = True) -> np.ndarray:
    """Sorted keys of the texts' distinct words, and of their word pairs: the text's number above 40 bits of the feature's hash."""
    w = Words(texts)
    if not len(w.hash):
        return np.zeros(0, np.uint64)
    h, doc = w.hash, w.doc
    if pairs:
        pair = np.flatnonzero(w.doc[1:] == w.doc[:-1])
        h = np.concatenate([h, mix(w.hash[pair] * np.uint64(3) + w.hash[pair + 1])])
        doc = np.concatenate([doc, w.doc[pair]])
    keys = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))  # a text's features side by side, each once
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) words of 64 bits, and which texts have a fingerprint."""
    keys, n = features(texts, pairs=False), len(texts)
    out = np.zeros((n, WORDS64), np.uint64)
    if not len(keys):
        return out, np.zeros(n, bool)
    doc = (keys >> np.uint64(40)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.append(first, len(keys)))
    # lanes hold sums up to 255: texts in stretches of 255 features
    pieces = -(-sizes // 255)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(first, pieces) + nth * 255
    feature = keys & np.uint64((1 << 40) - 1)
    ones = np.zeros((len(cuts), BITS), np.int32)
    step = 65_536
    bounds = np.append(cuts, len(keys))
    a = 0
    while a < len(cuts):  # bounded memory: stretches of some 65,536 features
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + step, "right")) - 1)
        f = feature[bounds[a] : bounds[b]]
        bits = np.empty((len(f), WORDS64), np.uint64)
        for k in range(WORDS64):
            bits[:, k] = mix(f, k + 1)
        lanes = _LANES[bits.view(np.uint8).reshape(len(f), BITS // 8)]
        ones[a:b] = np.add.reduceat(lanes, bounds[a:b] - bounds[a], axis=0).view(np.uint8).reshape(b - a, BITS)
        a = b
    total = np.add.reduceat(ones, np.cumsum(pieces) - pieces, axis=0)
    signs = np.packbits(2 * total > sizes[:, None], axis=1, bitorder="little")
    docs = doc[first]
    out[docs] = np.ascontiguousarray(signs).view(np.uint64)
    has = np.zeros(n, bool)
    has[docs] = True
    return out, has


def hit_rate(depth: int, distance: int) -> float:
    """Chance that two fingerprints that differ in ``distance`` bits agree on ``depth`` bits drawn without replacement."""
    return math.prod(max(0, BITS - distance - k) / (BITS - k) for k in range(depth))


def forest_shape(n: int, *, max_distance: int = MAX_DISTANCE, target: float = TARGET_RECALL, leaf: int = LEAF) -> tuple[int, int]:
    """(floor, tries) for n fingerprints: the depth at which a node holds ``leaf`` to twice as many, and the tries that reach the target there."""
    floor = min(KEY_BITS, BITS - max_distance, max(0, int(math.log2(max(n, 1) / leaf)) if n > leaf else 0))
    hit = hit_rate(floor, max_distance)
    return floor, 1 if hit >= target else math.ceil(math.log(1 - target) / math.log1p(-hit))


def permutations(trees: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(BITS)[:KEY_BITS] for _ in range(trees)])


def trie_keys(signatures: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """(tries, n): each fingerprint's place in each trie: the number of the trie above the first permuted bits."""
    n = len(signatures)
    bits = np.unpackbits(np.ascontiguousarray(signatures).view(np.uint8).reshape(n, BITS // 8), axis=1, bitorder="little")
    out = np.zeros((len(picks), n, 8), np.uint8)
    for t, pick in enumerate(picks):
        out[t, :, 0], out[t, :, 1] = t >> 8, t & 255
        out[t, :, 2:] = np.packbits(bits[:, pick], axis=1)
    return out.view(">i8")[:, :, 0].astype(np.int64)


def climbed(keys: np.ndarray, root: int, floor: int, leaf: int = LEAF) -> np.ndarray:
    """First row of the node in which each of the sorted ``keys`` is searched: at depth ``floor``, or the shortest prefix of ``root`` bits and more whose node holds ``leaf`` at most."""
    n = len(keys)
    node, settled = np.zeros(n, np.int64), np.zeros(n, bool)
    for depth in range(root, floor + 1):
        prefix = keys >> (KEY_BITS - depth)
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        size = np.diff(np.append(first, n))
        node = np.where(settled, node, np.repeat(first, size))
        settled |= np.repeat(size <= leaf, size)
        if settled.all():
            break
    return node


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.zeros((len(a), len(b)), np.uint16)
    for w in range(WORDS64):
        d += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return d


def _node_pairs(sig: np.ndarray, sure: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows within ``sure`` bits, and those beyond within ``upto``, all compared with all in blocks."""
    near, maybe = [], []
    step = max(1, 2_000_000 // len(sig))
    for s in range(0, len(sig), step):
        d = _distances(sig[s : s + step], sig[s:])
        x, y = np.nonzero(d <= upto)
        keep = x < y
        x, y = x[keep], y[keep]
        close = d[x, y] <= sure
        near.append((x[close] + s, y[close] + s))
        maybe.append((x[~close] + s, y[~close] + s))
    return tuple(np.concatenate([p[k] for p in part]) for part in (near, maybe) for k in (0, 1))


def _crowded_pairs(sig: np.ndarray, sure: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same groups and candidates between groups as ``_node_pairs``, with close fingerprints gathered around pivots."""
    around = min(AROUND, sure)
    left, members, radius = np.arange(len(sig)), [], []
    while len(left):
        d = np.bitwise_count(sig[left] ^ sig[left[0]]).sum(1, dtype=np.int32)
        members.append(left[d <= around])
        radius.append(int(d[d <= around].max()))
        left = left[d > around]
    pivots, radius, single = np.array([m[0] for m in members]), np.array(radius), np.array([len(m) == 1 for m in members])
    near, maybe = [(np.repeat(pivots, [len(m) for m in members]), np.concatenate(members))], []
    step = max(1, 2_000_000 // len(pivots))
    for s in range(0, len(pivots), step):
        d = _distances(sig[pivots[s : s + step]], sig[pivots[s:]]).astype(np.int32)
        x, y = np.nonzero(d <= upto + radius[s : s + step, None] + radius[None, s:])  # else all of both are farther apart
        keep = x < y
        x, y = x[keep], y[keep]
        alone = single[x + s] & single[y + s]
        close = d[x, y] <= sure
        near.append((pivots[x[alone & close] + s], pivots[y[alone & close] + s]))
        maybe.append((pivots[x[alone & ~close] + s], pivots[y[alone & ~close] + s]))
        for i, j in zip(x[~alone] + s, y[~alone] + s, strict=True):
            a, b = members[i], members[j]
            rows = max(1, 2_000_000 // len(b))
            for lo in range(0, len(a), rows):
                e = _distances(sig[a[lo : lo + rows]], sig[b])
                u, v = np.nonzero(e <= upto)
                close = e[u, v] <= sure
                near.append((a[u[close] + lo], b[v[close]]))
                if close.any():
                    break  # one group from here on, whatever else is near
                maybe.append((a[u + lo], b[v]))
    return tuple(np.concatenate([p[k] for p in part] or [np.zeros(0, np.int64)]) for part in (near, maybe) for k in (0, 1))


def links_and_candidates(ids: np.ndarray, sig: np.ndarray, node: np.ndarray, sure: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spanning stars (least id, other id) of the groups that pairs within ``sure`` bits form under each node, and all pairs (lesser id, other id) beyond them within ``upto`` bits that those leave apart. Rows are sorted by node."""
    n = len(ids)
    edges = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), n) if n else np.zeros(1, np.int64)
    size = np.diff(edges)
    parts = [[np.zeros(0, np.int64)] for _ in range(4)]
    small = np.repeat(size <= 24, size)
    rows, last, k = np.flatnonzero(small), np.repeat(edges[1:], size), 1
    while len(rows):  # small nodes, all at once
        rows = rows[rows + k < last[rows]]
        far = np.bitwise_count(sig[rows] ^ sig[rows + k]).sum(1, dtype=np.int32)
        near, maybe = far <= sure, (far > sure) & (far <= upto)
        for part, x in zip(parts, (rows[near], rows[near] + k, rows[maybe], rows[maybe] + k), strict=True):
            part.append(x)
        k += 1
    for at in np.flatnonzero(size > 24):
        lo, hi = edges[at], edges[at + 1]
        for part, x in zip(parts, (_crowded_pairs if hi - lo > CROWDED else _node_pairs)(sig[lo:hi], sure, upto), strict=True):
            part.append(x + lo)
    a, b, x, y = (np.concatenate(part) for part in parts)
    root, other = _stars(n, a, b, rank=ids)
    label = np.arange(n)
    label[other] = root
    apart = label[x] != label[y]
    x, y = ids[x[apart]], ids[y[apart]]
    return ids[root], ids[other], np.minimum(x, y), np.maximum(x, y)


def _stars(n: int, x: np.ndarray, y: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) pairs that connect what the edges connect; roots have the least rank."""
    order = np.argsort(rank, kind="stable") if rank is not None else np.arange(n)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    x, y = place[x], place[y]
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return order[label[member]], order[member]


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text key, text) -> (id, text key, signature); null where there is none."""
    for whole in batches:
        for batch in slices(whole, 2):
            sig, has = fingerprints(batch.column(2))
            values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
            values = pa.compute.if_else(pa.array(has), values, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], names=["id", "text_key", "signature"])


def _signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS64)


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text_key, signature`` of every row; ``text_key`` tells texts with the same id apart."""
    slim = docs.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.xxhash64(F.col(quoted(text_col))).alias("text_key"), F.col(quoted(text_col)).alias("text"))
    return slim.mapInArrow(_fingerprint_rows, "id bigint, text_key bigint, signature binary")


def forest_links(entries: DataFrame, n: int, *, max_distance: int = MAX_DISTANCE, sure: int = SURE_DISTANCE, target: float = TARGET_RECALL, leaf: int = LEAF) -> DataFrame:
    """``entries`` (entry, signature), distinct -> links (a, b, sure) with a < b between entries of one group, and, where not ``sure``, candidates that the texts decide on."""
    floor, trees = forest_shape(n, max_distance=max_distance, target=target, leaf=leaf)
    root, picks = max(0, floor - CLIMB), permutations(trees)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                sig = _signature_matrix(batch.column(1))
                for t in range(0, trees, 64):  # bounded memory, however many tries
                    for keys in trie_keys(sig, picks[t : t + 64]) + (t << KEY_BITS):
                        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0), batch.column(1)], names=["key", "entry", "signature"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # a root's rows may go on in the next batch

        def out(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            key, entry, sig = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b, c, d = links_and_candidates(entry, sig, climbed(key, root, floor, leaf), min(sure, max_distance), max_distance)
            known = np.arange(len(a) + len(c)) < len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, c]), pa.int64()), pa.array(np.concatenate([b, d]), pa.int64()), pa.array(known)], names=["a", "b", "sure"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, entry, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _signature_matrix(batch.column(2))
            top = key >> (KEY_BITS - root)
            first = int(np.searchsorted(top, top[-1], "left"))
            if first:
                yield out([*held, (key[:first], entry[:first], sig[:first])])
                held = []
            elif held and held[-1][0][-1] >> (KEY_BITS - root) != top[0]:
                yield out(held)
                held = []
            held.append((key[first:], entry[first:], sig[first:]))
        if held:
            yield out(held)

    spread_rows = entries.mapInArrow(spread, "key bigint, entry bigint, signature binary")
    sorted_tries = spread_rows.repartition(F.shiftright("key", KEY_BITS - root)).sortWithinPartitions("key")
    return sorted_tries.mapInArrow(compare, "a bigint, b bigint, sure boolean").distinct()


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, text) -> (entry, its features)."""
    for whole in batches:
        for batch in slices(whole, 1):
            keys = features(batch.column(1))
            offsets = np.searchsorted(keys, np.arange(batch.num_rows + 1, dtype=np.uint64) << np.uint64(40))
            values = pa.array((keys & np.uint64((1 << 40) - 1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)], names=["entry", "features"])


def alike(candidates: DataFrame, entries: DataFrame, docs: DataFrame, id_col: str, text_col: str, min_jaccard: float) -> DataFrame:
    """Those ``candidates`` (a, b) whose leading texts share ``min_jaccard`` of their features."""
    ends = candidates.select(F.col("a").alias("entry")).union(candidates.select("b")).distinct()
    wanted = cut(entries.join(ends, "entry", "left_semi").select("entry", F.coalesce("lead.id", F.lit(0)).alias("id"), F.col("lead.n").alias("none"), F.col("lead.text_key").alias("text_key")))
    small = F.broadcast(wanted) if wanted.count() < 500_000 else wanted  # a matter of speed: small enough, the texts need no exchange
    number = F.col(quoted(id_col)).cast("bigint")
    texts = docs.select(F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("none"), F.xxhash64(F.col(quoted(text_col))).alias("text_key"), F.col(quoted(text_col)).alias("text"))
    found = texts.join(small, ["id", "none", "text_key"]).select("entry", "text").mapInArrow(_feature_rows, "entry bigint, features array<bigint>")
    found = cut(found.dropDuplicates(["entry"]))  # repeated rows
    pairs = candidates.join(found.toDF("a", "of_a"), "a").join(found.toDF("b", "of_b"), "b")
    shared, total = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    return pairs.where(shared >= min_jaccard * (total - shared)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), a < b -> (entry, root) for every entry but roots. Large-star and small-star rounds until nothing moves."""
    edges = cut(links)
    state = F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))
    before = edges.agg(*state).first()
    while True:
        # large-star: neighbours above u go to the least of u's neighbours and u
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small-star: neighbours below u and u itself go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select("m", "b")).where("x <> y").distinct().toDF("a", "b")
        edges = cut(small)
        after = edges.agg(*state).first()
        if after == before:
            return edges.select(F.col("b").alias("entry"), F.col("a").alias("root"))
        before = after


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, sure: int = SURE_DISTANCE, min_jaccard: float = MIN_JACCARD, target: float = TARGET_RECALL, leaf: int = LEAF) -> DataFrame:
    """Every distinct (id, text) as ``doc_id, text_key, leader_id, leader_key, copies``: its group's leader, and how often the row is there."""
    rows = cut(fingerprint_table(docs, id_col, text_col))  # 60 bytes a document; the text is read once
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("text_key"))
    same = rows.where("signature IS NOT NULL").groupBy("signature").agg(F.min(order).alias("lead"))
    entries = cut(same.select(F.xxhash64("signature").alias("entry"), "signature", "lead"))
    n = entries.count()
    links = cut(forest_links(entries.select("entry", "signature"), n, max_distance=max_distance, sure=sure, target=target, leaf=leaf))
    held = alike(links.where("NOT sure").select("a", "b"), entries, docs, id_col, text_col, min_jaccard)
    moved = components(links.where("sure").select("a", "b").union(held))
    placed = entries.join(moved, "entry", "left").select("entry", "signature", "lead", F.coalesce("root", "entry").alias("root"))
    leads = placed.groupBy("root").agg(F.min("lead").alias("leader"), F.count(F.lit(1)).alias("k")).where("k > 1").select("root", "leader")
    placed = placed.join(leads, "root", "left").select("signature", F.coalesce("leader", "lead").alias("leader"))
    each = rows.groupBy("id", "text_key", "signature").agg(F.count(F.lit(1)).alias("copies"))
    found = each.join(placed, "signature", "left")
    return found.select(F.col("id").alias("doc_id"), "text_key", F.when(F.col("leader").isNull(), F.col("id")).otherwise(F.col("leader.id")).alias("leader_id"), F.when(F.col("leader").isNull(), F.col("text_key")).otherwise(F.col("leader.text_key")).alias("leader_key"), "copies")


def _is_leader() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("leader_id")) & (F.col("text_key") == F.col("leader_key"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` with one document of each group; one shuffle of the texts."""
    i, k, nth = fresh(docs.columns, "id", "key", "nth")
    leaders = groups(docs, id_col=id_col, text_col=text_col, **parameters).where(_is_leader())
    leaders = leaders.select(F.coalesce("doc_id", F.lit(0)).alias(i), F.col("text_key").alias(k))
    keyed = docs.withColumns({i: F.coalesce(F.col(quoted(id_col)).cast("bigint"), F.lit(0)), k: F.xxhash64(F.col(quoted(text_col)))})
    once = keyed.join(leaders.distinct(), [i, k], "left_semi")
    first = Window.partitionBy(i, k).orderBy(F.col(quoted(id_col)).cast("bigint").asc_nulls_last())
    return once.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*[F.col(quoted(c)) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group's leader and size; ``keep`` marks the one that stays."""
    found = groups(table(spark, sf_dir, "documents"))
    sizes = found.groupBy("leader_id", "leader_key").agg(F.sum("copies").alias("group_size")).where("group_size > 1")
    return found.join(sizes, ["leader_id", "leader_key"], "left").select("doc_id", "leader_id", F.coalesce("group_size", F.lit(1)).alias("group_size"), _is_leader().alias("keep"))
