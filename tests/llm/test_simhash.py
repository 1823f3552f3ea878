import random
import re

import numpy as np
import pyarrow as pa
import pytest

from turnstone.llm import simhash as S
from turnstone.llm.textkit import Words

SCHEMA = "doc_id bigint, text string, source string"


def corpus(seed=3, n=150):
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(5000)}" for _ in range(4000)]
    rows = []
    for k in range(n):
        base = [rnd.choice(words) for _ in range(rnd.choice([12, 60, 300]))]
        rows.append(base)
        for _ in range(rnd.choice([0, 0, 1, 3])):
            copy = base[:]
            for _ in range(max(1, len(copy) // 40)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(copy)
    rnd.shuffle(rows)
    return [(k, " ".join(r), "s") for k, r in enumerate(rows)]


def plain_features(text, pairs):
    w = re.findall(r"\w+", text.lower())
    return set(w) | ({(x, y) for x, y in zip(w, w[1:])} if pairs else set())


def mix(h, salt):
    m = (1 << 64) - 1
    h = (h + salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & m
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & m
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m
    return h ^ h >> 31


def plain_fingerprint(text):
    """The majority of the bits of each distinct word, by loops over Python integers."""
    ones, hashes = [0] * 256, {int(h) >> 24 for h in Words(pa.array([text], pa.string())).hash}
    for f in hashes:
        for k in range(4):
            x = mix(f, k + 1)
            for b in range(64):
                ones[64 * k + b] += x >> b & 1
    return sum(1 << b for b, n in enumerate(ones) if 2 * n > len(hashes))


def brute_groups(texts):
    """Least member of each text's group, and the matrix of near duplicates, by all pairs."""
    prints = [plain_fingerprint(t) if re.search(r"\w", t or "") else None for t in texts]
    near = np.zeros((len(texts), len(texts)), bool)
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if a is None or b is None:
                continue
            d = (a ^ b).bit_count()
            if d > S.SURE_DISTANCE and d <= S.MAX_DISTANCE:
                x, y = plain_features(texts[i], True), plain_features(texts[j], True)
                d = 0 if len(x & y) >= S.MIN_JACCARD * len(x | y) else 256
            near[i, j] = near[j, i] = d <= S.MAX_DISTANCE
    label = np.arange(len(texts))
    while True:
        low = np.minimum(np.where(near, label[None], len(texts)).min(1), label)
        if (low == label).all():
            return label, near
        label = low


def test_fingerprint_is_the_majority_of_feature_bits():
    texts = ["One two three", "", None, "one TWO three!", "ÉTÉ à", "été À", "a b a b a c d e f g h"]
    sig, has = S.fingerprints(pa.array(texts, pa.string()))
    assert has.tolist() == [True, False, False, True, True, True, True]
    assert (sig[0] == sig[3]).all() and (sig[4] == sig[5]).all() and (sig[0] != sig[4]).any()
    long = " ".join(f"x{k}" for k in range(5000))
    assert (S.fingerprints(pa.array([long, "a", long]))[0][0] == S.fingerprints(pa.array([long]))[0][0]).all()
    for t, row in [*zip(texts, sig), (long, S.fingerprints(pa.array([long]))[0][0])]:
        if t:
            assert int.from_bytes(row.tobytes(), "little") == plain_fingerprint(t)


def clustered(rng, centers, each, bits):
    """Fingerprints in clusters of which each member differs from its centre in up to so many bits."""
    sig = np.repeat(rng.integers(0, 2**64, (centers, 4), dtype=np.uint64), each, axis=0)
    for row in sig:
        flip = np.zeros(S.BITS, np.uint8)
        flip[rng.choice(S.BITS, rng.integers(0, bits + 1), replace=False)] = 1
        row ^= np.packbits(flip, bitorder="little").view(np.uint64)
    return sig


@pytest.mark.parametrize("centers, each, bits", [(40, 10, 25), (4, 200, 20), (2, 400, 10), (700, 1, 0)])
def test_links_within_nodes_equal_brute_force(centers, each, bits):
    rng = np.random.default_rng(centers)
    sig = clustered(rng, centers, each, bits)
    sig[1:3] = sig[0] ^ np.array([[2**30 - 1, 0, 2**12 - 1, 0], [0, 2**25 - 1, 0, 2**15 - 1]], np.uint64)  # 42 and 40 bits away
    n = len(sig)
    far = np.bitwise_count(sig[:, None] ^ sig[None]).sum(2, dtype=np.int32)
    for node in (np.arange(n) // 4, np.zeros(n, np.int64), np.sort(rng.integers(0, 7, n))):
        ids = rng.permutation(n).astype(np.int64)
        a, b, x, y = S.links_and_candidates(ids, sig, node, 36, 48)
        label, same = ids.copy(), node[:, None] == node[None]
        near = (far <= 36) & same
        while True:
            low = np.where(near, label[None], 10**9).min(1)
            if (low == label).all():
                break
            label = low
        assert set(zip(a.tolist(), b.tolist())) == {(int(r), int(i)) for r, i in zip(label, ids) if r != i}
        i, j = np.nonzero((far > 36) & (far <= 48) & same & (label[:, None] != label[None]))
        assert set(zip(x.tolist(), y.tolist())) == {(int(min(ids[p], ids[q])), int(max(ids[p], ids[q]))) for p, q in zip(i, j)}


def test_depth_follows_density():
    rng = np.random.default_rng(1)
    keys = np.sort(np.concatenate([rng.integers(0, 2**S.KEY_BITS, 200), rng.integers(0, 2 ** (S.KEY_BITS - 5), 3000)]))
    got = S.climbed(keys, 2, 9, leaf=64)
    for k, key in enumerate(keys):
        for depth in range(2, 10):
            inside = np.flatnonzero(keys >> (S.KEY_BITS - depth) == key >> (S.KEY_BITS - depth))
            if len(inside) <= 64 or depth == 9:
                assert got[k] == inside[0]
                break
    assert len({int(c) for c in np.unique(got, return_counts=True)[1]}) > 5


def test_forest_shape_reaches_the_target():
    for n in (0, 1, 2, 50, 10_000, 256_000, 10**8, 10**11):
        floor, trees = S.forest_shape(n)
        assert 1 - (1 - S.hit_rate(floor, S.MAX_DISTANCE)) ** trees >= S.TARGET_RECALL - 1e-12
        assert n < 2 * S.LEAF or S.LEAF <= n / 2**floor <= 2 * S.LEAF


@pytest.mark.parametrize("n", [10_000, 10**6, 3 * 10**7])
def test_recall_at_the_limit_with_the_depth_of_large_inputs(n):
    floor, trees = S.forest_shape(n)
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, (1500, 4), dtype=np.uint64)
    flip = np.zeros((1500, S.BITS), np.uint8)
    for row in flip:
        row[rng.choice(S.BITS, S.MAX_DISTANCE, replace=False)] = 1
    b = a ^ np.packbits(flip, axis=1, bitorder="little").view(np.uint64)
    x, y = (S.trie_keys(s, S.permutations(trees)) >> (S.KEY_BITS - floor) for s in (a, b))
    assert (x == y).any(axis=0).mean() >= S.TARGET_RECALL - 0.02


def test_recall_of_the_forest_by_distance(spark):
    """Pairs planted among 20,000 random entries at 20 to 48 bits."""
    rng = np.random.default_rng(8)
    sig = rng.integers(0, 2**64, (20_000, 4), dtype=np.uint64)
    planted = {}
    for k, d in enumerate((20, 33, 40, 48)):
        for at in range(2000 * k, 2000 * k + 600, 2):
            flip = np.zeros(S.BITS, np.uint8)
            flip[rng.choice(S.BITS, d, replace=False)] = 1
            sig[at + 1] = sig[at] ^ np.packbits(flip, bitorder="little").view(np.uint64)
            planted.setdefault(d, []).append((at, at + 1))
    entries = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sig)], "entry bigint, signature binary").repartition(4)
    rows = S.forest_links(entries, len(sig)).collect()
    got = {(r.a, r.b) for r in rows}
    for d, pairs in planted.items():
        assert np.mean([p in got for p in pairs]) >= (0.99 if d <= 33 else 0.92), d
    assert all(r.sure == (np.bitwise_count(sig[r.a] ^ sig[r.b]).sum() <= S.SURE_DISTANCE) for r in rows) and len(got) <= 1200


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 9), (4, 9), (4, 5), (10, 20), (11, 20), (11, 21), (12, 21)]
    got = {(r.entry, r.root) for r in S.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(2, 1), (3, 1), (5, 4), (9, 4), (20, 10), (11, 10), (21, 10), (12, 10)}
    assert S.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_recall_and_precision_against_brute_force(spark):
    rows = corpus(n=110)
    label, near = brute_groups([t for _, t, _ in rows])
    found = {r.doc_id: r.leader_id for r in S.groups(spark.createDataFrame(rows, SCHEMA), leaf=16).collect()}
    pairs = [(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)))]
    assert len(pairs) > 50
    assert np.mean([found[i] == found[j] for i, j in pairs]) >= 0.9
    assert all(label[i] == label[found[i]] for i in found)  # nothing is joined that brute force doesn't join


def test_near_copies_by_their_texts(spark):
    """Copies with 10 of 100 words changed, beside texts that share a quarter of their words."""
    rnd = random.Random(21)
    rows = []
    for k in range(60):
        base = [f"v{rnd.randrange(10**6)}" for _ in range(100)]
        copy, other = base[:], base[:25] + [f"u{rnd.randrange(10**6)}" for _ in range(75)]
        for at in rnd.sample(range(100), 10):
            copy[at] = f"n{rnd.randrange(10**6)}"
        rows += [(3 * k + j, " ".join(t), "s") for j, t in enumerate((base, copy, other))]
    leader = {r.doc_id: r.leader_id for r in S.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    joined = [leader[3 * k] == leader[3 * k + 1] for k in range(60)]
    assert np.mean(joined) >= 0.95
    assert all(leader[3 * k + 2] == 3 * k + 2 for k in range(60))


def test_texts_decide_beyond_the_sure_distance(spark):
    """Pairs of 37 to 48 bits: those whose words stand in the same order are joined, those of the same words shuffled are not."""
    rnd, rows, kind = random.Random(4), [], {}
    while min(list(kind.values()).count(x) for x in (0, 1)) < 6:
        base = [f"v{rnd.randrange(10**6)}" for _ in range(60)]
        copy, k = base[:], len(rows)
        for at in rnd.sample(range(60), 9):
            copy[at] = f"n{rnd.randrange(10**6)}"
        d = (plain_fingerprint(" ".join(base)) ^ plain_fingerprint(" ".join(copy))).bit_count()
        if not S.SURE_DISTANCE < d <= S.MAX_DISTANCE:
            continue
        if len(kind) % 2:
            rnd.shuffle(copy)
        kind[k] = len(kind) % 2
        rows += [(k, " ".join(base), "s"), (k + 1, " ".join(copy), "s")]
    leader = {r.doc_id: r.leader_id for r in S.groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: leader[k + 1] != k for k in kind} == {k: bool(x) for k, x in kind.items()}


def test_one_of_each_group_stays(spark):
    rows = [(7, "The quick brown fox", "a"), (3, "the QUICK brown fox.", "b"), (3, "the QUICK brown fox.", "b"), (None, "other words entirely here", "a"), (9, "", "a"), (10, None, "a"), (11, "?!", "a"), (11, "?!", "a"), (12, "something else", None), (12, "two texts one id", None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS signature", "2 AS __nth", "3 AS id")
    out = S.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, str(r.text)) for r in out.collect())
    assert got == [(0, "other words entirely here"), (3, "the QUICK brown fox."), (9, ""), (10, "None"), (11, "?!"), (12, "something else"), (12, "two texts one id")]
    assert S.deduplicated(docs.where("false")).count() == 0


def test_thousands_of_copies(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the same text again and again' AS text", "'s' AS source")
    assert [r.doc_id for r in S.deduplicated(docs).collect()] == [0]
    with pytest.raises(TypeError):
        S.groups(docs, unknown=1)
