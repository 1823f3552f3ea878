import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnstone.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def parts():
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    return ranks, bpe.Encoder(ranks, bpe.lookahead_of(bpe.VOCABULARY))


def tiny():
    """A vocabulary in which what comes later steers a merge from far away."""
    words = [bytes([b]) for b in b"abc"] + [b"bc", b"ab", b"abab", b"ca", b"cab", b"aa", b"aaaa"]
    return {w: k for k, w in enumerate(words)}


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=200), st.lists(st.integers(1, 9), min_size=1, max_size=20))
def test_stream_equals_whole(text, cuts):
    ranks, data, at, k, got = tiny(), text.encode(), 0, 0, []
    t = bpe.Transducer(ranks, bpe.sufficient_lookahead(ranks))
    t.room = t.lookahead + 3  # small buffers, so that lookahead alone decides
    while at < len(data):
        n = cuts[k % len(cuts)]
        got += t.feed(data[at : at + n])
        at, k = at + n, k + 1
    assert got + t.finish() == [ranks[p] for p in bpe.merge(data, ranks)]
    assert len(t.buffer) <= t.room


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=24, max_size=120))
def test_heap_equals_rescan(text):
    ranks, parts = tiny(), [bytes([b]) for b in text.encode()]
    while True:
        pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not pairs:
            break
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert bpe.merge(text.encode(), ranks) == parts


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_against_tiktoken_and_round_trip(parts, text):
    import tiktoken

    ranks, enc = parts
    ids = enc.encode(text)
    assert ids == tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    assert enc.decode(ids, chunk=1) == text


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 5))
def test_decoder_equals_whole_decode(data, step):
    d = bpe.Decoder([bytes([b]) for b in range(256)])
    got = "".join([d.feed(list(data[k : k + step])) for k in range(0, len(data), step)] + [d.finish()])
    assert got == data.decode("utf-8", "replace")


def test_long_piece(parts):
    ranks, enc = parts
    text = "ab" * 30_000 + "x" * 20_000
    assert enc.encode(text) == [ranks[p] for p in bpe.merge(text.encode(), ranks)]


def test_long_texts_are_split_as_they_are_encoded(parts, monkeypatch):
    _, enc = parts
    text = "It's  a test, isn't it?  \n\n 12345 é" * 3000
    whole = enc.encode(text)
    monkeypatch.setattr(bpe, "BLOCK", 10)
    assert enc.encode(text) == whole and enc.gives(whole, text) and not enc.gives(whole[:-1], text) and not enc.gives(whole, text + "x")


def test_table(spark):
    rows = [(1, "Hello, world", "x", 1), (1, "Hello, world", "x", 1), (None, "é" * 10, None, 2), (3, "", "y", 3), (4, None, "y", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int").selectExpr("*", "1 AS `a.b`")
    got = bpe.encode_documents(docs, keep=("source",)).collect()
    by = sorted(((r.doc_id or 0), r.n_tokens, r.tokens is None, r.round_trip, r.source) for r in got)
    assert [x[2] for x in by] == [False, False, False, False, True] and all(x[3] for x in by)
    assert by[1] == by[2] and by[4][1] == 0
    assert bpe.encode_documents(docs.where("false")).count() == 0
