import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from turnstone.llm import ctw

SCHEMA = "doc_id bigint, text string"


def brute(texts, depth):
    """CTW by its definition: one tree a binary node, recursion over contexts, exact fractions for the predictive mix."""
    seqs = [b"\0" * depth + (t or "").encode() for t in texts]
    counts = Counter()
    for s in seqs:
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                ctx = s[i - d : i][::-1]
                for j in range(8):
                    counts[(1 << j) | (s[i] >> (8 - j)), ctx, s[i] >> (7 - j) & 1] += 1
    contexts = {(b, c) for b, c, _ in counts}
    children = {}
    for b, c in contexts:
        if c:
            children.setdefault((b, c[:-1]), []).append(c)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(b, c):
        own = kt(counts[b, c, 0], counts[b, c, 1])
        if len(c) == depth:
            return own
        return np.logaddexp(own, sum(weighted(b, x) for x in children[b, c])) - math.log(2)

    def p(b, path, bit, d=0):
        c = path[:d]
        z = (counts[b, c, bit] + 0.5) / (counts[b, c, 0] + counts[b, c, 1] + 1)
        if d == depth:
            return z
        w = math.exp(kt(counts[b, c, 0], counts[b, c, 1]) - math.log(2) - weighted(b, c))
        return w * z + (1 - w) * p(b, path, bit, d + 1)

    out = []
    for s in seqs:
        bits = 0.0
        for i in range(depth, len(s)):
            path = s[i - depth : i][::-1]
            for j in range(8):
                bits -= math.log2(p((1 << j) | (s[i] >> (8 - j)), path, s[i] >> (7 - j) & 1))
        out.append(bits)
    return out


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_equals_definition(spark, depth):
    texts = ["the cat sat on the mat", "the cat sat on the mat", "", None, "ébène", "a", "x" * 300, "the mat sat on the cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: r for r in ctw.code_lengths(docs, depth=depth).collect()}
    for k, bits in enumerate(brute(texts, depth)):
        assert got[k].code_bits == pytest.approx(bits, abs=0.02)
        assert got[k].n_bytes == len((texts[k] or "").encode())
        assert (got[k].bits_per_byte is None) == (not texts[k])


def test_kt_large():
    a, b = np.array([0.0, 3, 70000, 1e9]), np.array([0.0, 5, 12, 2e9])
    want = [math.lgamma(x + 0.5) + math.lgamma(y + 0.5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, b)]
    assert np.allclose(ctw.kt(a, b), want, rtol=1e-12, atol=1e-6)


def test_empty_and_clashing_columns(spark):
    assert ctw.code_lengths(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "abc", 1, 2), (None, "abc", 1, 2)], "doc_id bigint, text string, block int, key int")
    assert [r.n_bytes for r in ctw.code_lengths(docs.selectExpr("*", "1 AS `a.b`", "2 AS text_")).collect()] == [3, 3]


def test_long_texts_and_many_blocks(spark, monkeypatch):
    texts = ["abcab" * 4000, None, "", "abcab" * 4000] + [f"t{k}" for k in range(30)]
    monkeypatch.setattr(ctw, "BLOCK_ROWS", 3)
    got = {r.doc_id: r for r in ctw.code_lengths(spark.createDataFrame(list(enumerate(texts)), SCHEMA), depth=2).collect()}
    want = brute(texts, 2)
    assert got[0].n_bytes == 20_000 and got[0].code_bits == got[3].code_bits == pytest.approx(want[0], rel=1e-4)
    assert [got[k].code_bits for k in range(4, 34)] == pytest.approx(want[4:], abs=0.02)


def test_file_blocks_and_chunks(spark, tmp_path, monkeypatch):
    texts = [f"document {k} " + "lorem ipsum dolor " * (k % 7) for k in range(60)]
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(ctw, "CHUNK", 50)
    got = {r.doc_id: r.code_bits for r in ctw.code_lengths(spark.read.parquet(str(tmp_path / "d")), depth=3).collect()}
    assert [got[k] for k in range(60)] == pytest.approx(brute(texts, 3), abs=0.05)
