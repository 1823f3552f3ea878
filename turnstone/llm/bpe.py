"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

The merge list says how far a merge can be steered by what follows. A merge of
(u, v) at rank r depends on bytes to its right only through merges of lower
rank that take part of v; those depend on merges of lower rank again. Adding
up, over the list in order of rank, how far such a chain reaches gives the
list's *sufficient lookahead* L: tokens that end L bytes or more before the end
of what was read are final (Berglund & van der Merwe, "Formalizing BPE
Tokenization", bound it for any list; ``sufficient_lookahead`` computes the
list's own). The transducer holds a buffer of 4 L bytes, merges it, emits what
is final and drops it, so it needs constant memory on a text of any length. As
every stretch of a correct encoding is the correct encoding of its bytes, going
on from an emitted boundary gives what merging the whole text would.

The pattern that splits text before merging makes most pieces far shorter than
L; they go through the transducer once and are remembered, in a table of
bounded size. Texts longer than ``BLOCK`` are split piece by piece as they are
encoded, and tokens are compared with the text as they are decoded, so that
beside the text and its tokens memory is constant.

``Decoder`` turns ids into text with a state of at most three bytes, those of a
character whose end is still to come; bytes that are no UTF-8 become U+FFFD.

The vocabulary is read on the driver and broadcast (a file of fixed size);
executors need no copy of it.

Defined results: null text gives null tokens, 0 of them; the empty text gives
an empty list; texts are encoded whole whatever their length; of merges that tie
in rank (equal pairs) the leftmost goes first; repeated rows give repeated
results; a null id is passed on; an empty table gives an empty table; only the
id and text columns and those in ``keep`` are read, so others can have any name.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.common import quoted, table
from turnstone.llm.textkit import slices

#: Rank file and split pattern; both are parameters of every entry point.
VOCABULARY = os.environ.get("TURNSTONE_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker before it starts over.
REMEMBERED = 400_000
#: Characters up to which a text's pieces are listed at once.
BLOCK = 1 << 16


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    return parse_ranks(Path(path).read_bytes())


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after a token that make it final, whatever comes next."""
    reach: dict[bytes, int] = {}  # left part -> how far right of it a merge with it can be steered from
    inner: dict[bytes, tuple[bytes, ...]] = {}
    lefts = {w[:k] for w in ranks for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks}
    most = 0
    for w, r in sorted(ranks.items(), key=lambda x: x[1]):
        n, found = len(w), []
        for k in range(1, n):
            u, v = w[:k], w[k:]
            if ranks.get(u, r) < r and ranks.get(v, r) < r:
                if v not in inner:
                    inner[v] = tuple({v[a:b] for a in range(n - k) for b in range(a + 1, n - k + 1)} & lefts)
                found.append((u, n - k + max((reach[x] for x in inner[v] if x in reach), default=0)))
        for u, far in found:
            if far > reach.get(u, 0):
                reach[u] = far
                most = max(most, far)
    return most


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """``piece`` merged by rank, leftmost first."""
    if piece in ranks:
        return [piece]
    n = len(piece)
    if n < 24:
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [ranks.get(piece[i : i + 2]) for i in range(n - 1)]
        while True:
            low, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
    end = list(range(1, n + 1))  # of the part that starts at i; 0 where none does
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, hi = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != hi:
            continue
        end[i], end[mid] = hi, 0
        if hi < n:
            before[hi] = i
            if (r := ranks.get(piece[i : end[hi]])) is not None:
                heapq.heappush(heap, (r, i, hi, end[hi]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:hi])) is not None:
            heapq.heappush(heap, (r, p, i, hi))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


class Transducer:
    """Bytes in, ids out, as soon as they are final."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int):
        self.ranks, self.lookahead, self.buffer = ranks, lookahead, b""
        self.room = max(256, 4 * lookahead)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for lo in range(0, len(data), self.room):
            self.buffer += data[lo : lo + self.room]
            if len(self.buffer) >= self.room:
                final, at = len(self.buffer) - self.lookahead, 0
                for part in merge(self.buffer, self.ranks):
                    if at + len(part) > final:
                        break
                    out.append(self.ranks[part])
                    at += len(part)
                self.buffer = self.buffer[at:]
        return out

    def finish(self) -> list[int]:
        out = [self.ranks[p] for p in merge(self.buffer, self.ranks)] if self.buffer else []
        self.buffer = b""
        return out


#: Bytes that follow a first byte; 0 for ASCII, for bytes that can't be first and for those that only overlong or too large characters begin with.
_FOLLOW = bytes(1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0 for b in range(256))


class Decoder:
    """Ids in, text out, as soon as its characters are whole."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.pending = pieces, b""

    def feed(self, ids: list[int]) -> str:
        data = self.pending + b"".join(map(self.pieces.__getitem__, ids))
        cut = n = len(data)
        for back in range(1, min(3, n) + 1):
            b = data[n - back]
            if b & 0xC0 != 0x80:
                if _FOLLOW[b] >= back and (back == 1 or _second_fits(b, data[n - back + 1])):
                    cut = n - back
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.pending = self.pending, b""
        return data.decode("utf-8", "replace")


def _second_fits(first: int, second: int) -> bool:
    return not (first == 0xE0 and second < 0xA0 or first == 0xED and second > 0x9F or first == 0xF0 and second < 0x90 or first == 0xF4 and second > 0x8F)


class Encoder(dict):
    """Piece -> ids, filled on demand through the transducer."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int, pattern: str = PATTERN):
        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.transducer = Transducer(ranks, lookahead)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for w, r in ranks.items():
            self.pieces[r] = w

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = tuple(self.transducer.feed(piece.encode()) + self.transducer.finish())
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def pieces_of(self, text: str) -> Iterable[str]:
        if len(text) <= BLOCK:
            return self.pattern.findall(text)
        return (m.group() for m in self.pattern.finditer(text))

    def ids(self, text: str) -> array:
        return array("i", itertools.chain.from_iterable(map(self.__getitem__, self.pieces_of(text))))

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def texts(self, ids: array | list[int], chunk: int = 4096) -> Iterator[str]:
        """The text of ``ids``, as it becomes whole."""
        decoder = Decoder(self.pieces)
        for k in range(0, len(ids), chunk):
            yield decoder.feed(ids[k : k + chunk])
        yield decoder.finish()

    def decode(self, ids: array | list[int], chunk: int = 4096) -> str:
        return "".join(self.texts(ids, chunk))

    def gives(self, ids: array | list[int], text: str) -> bool:
        """Whether ``ids`` decode to ``text``."""
        at = 0
        for part in self.texts(ids):
            if not text.startswith(part, at):
                return False
            at += len(part)
        return at == len(text)


@lru_cache(2)
def encoder(data: bytes, pattern: str, lookahead: int) -> Encoder:
    return Encoder(parse_ranks(data), lookahead, pattern)


@lru_cache(4)
def lookahead_of(path: str) -> int:
    return sufficient_lookahead(load_ranks(path))


def encode_documents(docs: DataFrame, *, vocabulary: str = VOCABULARY, pattern: str = PATTERN, lookahead: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, columns ``keep``, ``n_tokens``, ``tokens`` and ``round_trip``: whether they decode to the text again."""
    if lookahead is None:
        lookahead = lookahead_of(vocabulary)
    data = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value, pattern, lookahead)
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                flat, counts, same, nulls = [], [], [], []
                for t in batch.column(1):
                    t = t.as_py()
                    ids = enc.ids(t) if t else array("i")
                    flat.append(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32))
                    counts.append(len(ids))
                    nulls.append(t is None)
                    same.append(t is None or enc.gives(ids, t))
                offsets = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                starts = pa.array(offsets, pa.int32(), mask=np.array([*nulls, False]))
                tokens = pa.ListArray.from_arrays(starts, pa.array(np.concatenate([*flat, np.zeros(0, np.int32)]), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(counts, pa.int32()), tokens, pa.array(same, pa.bool_())], names=["doc_id", *keep, "n_tokens", "tokens", "round_trip"])

    chosen = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.col(quoted(text_col)), *[F.col(quoted(c)) for c in keep])
    kept = "".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return chosen.mapInArrow(run, f"doc_id bigint, {kept}n_tokens int, tokens array<int>, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
