"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its embedding (words of the training sample that are frequent
enough; all others share one) beside the mean embedding of its runs of three
and of five characters, so that unseen spellings are read by their characters.
GRUs run over a window in both directions, attention pools their states, and a
logistic unit scores the window. Every text is scored on *all* windows of ``WINDOW`` words at
steps of ``STEP``, the last one ending with the text; its score is the highest.

Training is in numpy (backpropagation through time, Adam), on every labelled
document but the fifth of them (by a hash of the id) that sets the threshold.
It begins on the driver, on at most ``toxic_docs`` + ``clean_docs`` documents
with at most ``sampled`` windows each: that only gives the parameters from which
all shards start. Then the labelled documents, whole and in windows that tile
them, are gone over on the executors, in shards of about ``SHARD`` documents by
a hash of their id, and the shards' parameters are averaged, weighted by
windows. Labels are of documents, so only the windows of a toxic document that
score highest count as toxic (at the start after a third of the rounds). The
threshold is the middle of the widest best gap (F1) over the scores of all
held-out documents. The network's size is fixed: embeddings of the
``VOCABULARY`` words that stand in most labelled documents that train,
``LEAST_DOCS`` of them or more, and ``NGRAMS`` hashed character runs, which read
all other words.

Defined results: texts without a word (null and empty ones too) have no
windows, a null score and are not toxic; very long texts are scored on all
their windows, ``_SLICE`` bytes of texts (one text at least) at a time; of
windows that tie the first is the worst; a score that ties with the threshold
is toxic; labels that are null, of no document or of one class only train
nothing: then all scores are null and nothing is toxic; where only the held-out
fifth has some class, nothing is held out; held-out documents of
one class only leave the threshold at even odds; repeated rows get equal scores
(repeated labels of an id count once, toxic if any is); null ids
are scored and never learned from; an empty table gives an empty table; other columns
are passed over (query) or passed on (pipeline), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.common import mapped, quoted, table
from turnstone.llm.textkit import Words, mix, slices

WINDOW, STEP = 32, 16
#: Bounds of what the start is trained on, documents by class, windows a document; of every ``HELD_OUT`` documents one sets the threshold.
TOXIC_DOCS, CLEAN_DOCS, SAMPLED_WINDOWS, HELD_OUT = 1200, 2000, 6, 5
#: Labelled documents a shard; windows that a shard holds at once, and learns from in one step, at which rate; numbers in a row of parameters; labels up to which they are broadcast.
SHARD, HELD_WINDOWS, SHARD_BATCH, SHARD_RATE, BLOCK, BROADCAST = 4000, 8192, 256, 0.004, 4096, 2_000_000
HIDDEN, WORD_DIM, CHAR_DIM, VOCABULARY, NGRAMS, LEAST_DOCS = 12, 8, 12, 4096, 32768, 4
ROUNDS, LEAST_STEPS, BATCH, RATE, DECAY, SEED = 4, 800, 64, 0.02, 0.02, 11
#: Logits that differ by less tie: single precision depends on how windows are batched.
TIE = 1e-3
_SLICE = 1 << 20


@dataclass
class Tokens:
    """Words of some texts by type: ``token`` is the type of each word; a type has its hash and character runs ``grams[at[k]:at[k+1]]``."""

    token: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    grams: np.ndarray
    at: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    w = Words(texts)
    types, where, token = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[where], w.end[where] - w.start[where]
    ends = np.concatenate([[0], np.cumsum(size)])
    nth = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    here, left = np.repeat(start, size) + nth, np.repeat(size, size) - nth - 1
    low = np.concatenate([w.low, [0, 0]]).astype(np.uint64)
    key, grams = np.zeros(len(here), np.uint64), np.empty((len(here), 2), np.int32)
    for column, reach in enumerate((1, 2)):  # runs of three and of five around each character; beyond a word's ends stand 1 and 2
        key[:] = reach
        for by in range(-reach, reach + 1):
            byte = low[here + by] if by else low[here]
            key = (key << np.uint64(8)) | np.where(nth + by < 0, np.uint64(1), np.where(by > left, np.uint64(2), byte))
        grams[:, column] = (mix(key) % np.uint64(NGRAMS)).astype(np.int32)
    return Tokens(token, w.first, types, grams.ravel(), 2 * ends)


def spans(first: np.ndarray, window: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, words) of all windows: each ``step`` words, the last one flush with the end."""
    n = np.diff(first)
    many = np.where(n == 0, 0, np.where(n <= window, 1, 1 + -(-(n - window) // step)))
    doc = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(n[doc], window)
    return doc, first[doc] + np.minimum(nth * step, n[doc] - size), size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sum_rows(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Row k of the result: the sum of ``rows`` whose ``to`` is k."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(to):
        order = np.argsort(to, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0]))
        out[to[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes; embedding row 0 is for all others
    p: dict[str, np.ndarray]
    threshold: float = 0.0
    _adam: dict = field(default_factory=dict, repr=False)

    @classmethod
    def new(cls, vocabulary: np.ndarray, seed: int = SEED) -> Model:
        rng, h, d = np.random.default_rng(seed), HIDDEN, WORD_DIM + CHAR_DIM
        p = {"word": rng.normal(0, 0.3, (len(vocabulary) + 1, WORD_DIM)), "char": rng.normal(0, 0.3, (NGRAMS, CHAR_DIM)), "attend": rng.normal(0, 0.3, 2 * h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.full(1, -1.0)}
        for way in "fb":
            p |= {f"x{way}": rng.normal(0, d**-0.5, (d, 3 * h)), f"b{way}": np.zeros(3 * h), f"u{way}": rng.normal(0, h**-0.5, (h, 3 * h))}
        return cls(vocabulary, {k: v.astype(np.float32) for k, v in p.items()})

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, ids: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Input of each word type."""
        size = np.diff(at)
        chars = np.add.reduceat(self.p["char"][grams], at[:-1], axis=0) / size[:, None].astype(np.float32) if len(size) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][ids], chars], axis=1)

    def _states(self, way: str, projected: np.ndarray, index: np.ndarray, inside: np.ndarray, full: bool, keep: list | None = None) -> np.ndarray:
        """States (time, window, hidden) of one direction; ``index`` (time, window) are rows of ``projected``."""
        h3, h = projected.shape[1], HIDDEN
        steps, n = index.shape
        u = self.p[f"u{way}"]
        out = np.empty((steps, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x, s = projected[index[t]], state @ u
            gates = x[:, : 2 * h] + s[:, : 2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * s[:, 2 * h :])
            after = new + z * (state - new)
            if not full:
                after = np.where(inside[t][:, None], after, state)
            if keep is not None:
                keep.append((t, state, z, r, new, s[:, 2 * h : h3]))
            out[t] = state = after
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``x``: inputs of types, ``index`` (window, time) of types."""
        steps = index.shape[1]
        inside = np.arange(steps)[:, None] < size[None, :]
        full, turned = bool(inside.all()), np.ascontiguousarray(index.T)
        both = []
        for way in "fb":
            trail = [] if keep is not None else None
            both.append(self._states(way, x @ self.p[f"x{way}"] + self.p[f"b{way}"], turned, inside, full, trail))
            if keep is not None:
                keep[way] = trail
        states = np.concatenate(both, axis=2)
        a = states @ self.p["attend"]
        if not full:
            a = np.where(inside, a, -1e9)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        if keep is not None:
            keep |= {"states": states, "a": a, "pooled": pooled, "inside": inside, "turned": turned}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def learn(self, ids: np.ndarray, grams: np.ndarray, at: np.ndarray, index: np.ndarray, size: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One step of Adam on windows of the types ``ids``; the loss."""
        keep: dict = {}
        x = self.inputs(ids, grams, at)
        logit = self.forward(x, index, size, keep)
        q, n, h = _sigmoid(logit), len(y), HIDDEN
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((q - y) / n).astype(np.float32)
        g["bias"][0], g["out"] = d.sum(), keep["pooled"].T @ d
        dp = d[:, None] * self.p["out"]
        da = np.einsum("nh,tnh->tn", dp, keep["states"])
        da = keep["a"] * (da - (da * keep["a"]).sum(0))
        g["attend"] = np.einsum("tn,tnh->h", da, keep["states"])
        ds = keep["a"][:, :, None] * dp[None] + da[:, :, None] * self.p["attend"]
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            u, carry = self.p[f"u{way}"], np.zeros((n, h), np.float32)
            moves = np.zeros((*keep["turned"].shape, 3 * h), np.float32)
            for t, state, z, r, new, s in reversed(keep[way]):
                inside = keep["inside"][t][:, None]
                dh = ds[t, :, k * h : (k + 1) * h] + carry
                live = np.where(inside, dh, 0)
                dn = live * (1 - z) * (1 - new * new)
                dz, dr = live * (state - new) * z * (1 - z), dn * s * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"u{way}"] += state.T @ du
                carry = np.where(inside, dh * z, dh) + du @ u.T
                moves[t] = np.concatenate([dz, dr, dn], axis=1)
            dproj = _sum_rows(moves.reshape(-1, 3 * h), keep["turned"].ravel(), len(x))
            g[f"x{way}"], g[f"b{way}"] = x.T @ dproj, dproj.sum(0)
            dx += dproj @ self.p[f"x{way}"].T
        g["word"] = _sum_rows(dx[:, :WORD_DIM], ids, len(g["word"]))
        g["char"] = _sum_rows(np.repeat(dx[:, WORD_DIM:] / np.diff(at)[:, None].astype(np.float32), np.diff(at), axis=0), grams, NGRAMS)
        step = self._adam["n"] = self._adam.get("n", 0) + 1
        for k, v in self.p.items():
            m, s = self._adam.get(k, (np.zeros_like(v), np.zeros_like(v)))
            m, s = 0.9 * m + 0.1 * g[k], 0.99 * s + 0.01 * g[k] ** 2
            self._adam[k] = (m, s)
            if k in ("word", "char"):
                v *= 1 - rate * DECAY
            v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return float(np.mean(np.logaddexp(0, np.where(y > 0.5, -logit, logit))))

    def windows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word in the text, logit) of all windows."""
        t = tokens(texts)
        doc, start, size = spans(t.first)
        logit = np.empty(len(doc), np.float32)
        x = self.inputs(self.word_ids(t.hash), t.grams, t.at)
        last = max(len(t.token) - 1, 0)
        for part in (np.flatnonzero(size == WINDOW), np.flatnonzero(size < WINDOW)):  # windows that are full need no mask
            for lo in range(0, len(part), 1024):
                k = part[lo : lo + 1024]
                index = t.token[np.minimum(start[k][:, None] + np.arange(int(size[k].max())), last)]
                logit[k] = self.forward(x, index, size[k])
        return doc, start - t.first[doc], logit


def _batch(t: Tokens, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows as rows of types -> the types in them, their runs and the places of the windows among these types."""
    types, inverse = np.unique(index, return_inverse=True)
    sizes = np.diff(t.at)[types]
    at = np.concatenate([[0], np.cumsum(sizes)])
    grams = t.grams[np.repeat(t.at[types], sizes) + np.arange(at[-1]) - np.repeat(at[:-1], sizes)]
    return types, grams, at, inverse.reshape(index.shape)


def train(texts: list[str], docs: np.ndarray, labels: np.ndarray, vocabulary: np.ndarray, *, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Windows with their document and its label -> model that embeds the words of ``vocabulary`` (sorted hashes)."""
    t = tokens(pa.array(texts, pa.string()))
    n = np.diff(t.first)
    model, rng = Model.new(vocabulary, seed), np.random.default_rng(seed)
    ids = model.word_ids(t.hash)
    size = np.minimum(n, WINDOW)
    used = np.flatnonzero(size > 0)
    index = t.token[np.minimum(t.first[:-1, None] + np.arange(WINDOW), max(len(t.token) - 1, 0))] if len(t.token) else np.zeros((len(n), WINDOW), np.int64)

    chosen = used
    rounds = max(rounds, -(-LEAST_STEPS * BATCH // max(1, len(used))))  # small samples are gone over more often
    for epoch in range(rounds):
        order = rng.permutation(chosen)
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            types, grams, at, places = _batch(t, index[rows])
            own = np.where(rng.random(len(types)) < 0.1, 0, ids[types])  # some words are read by their characters alone
            model.learn(own, grams, at, places, size[rows], labels[rows], RATE * 0.25 ** (epoch / rounds))
        if 3 * (epoch + 1) < rounds:
            continue
        score = np.full(len(n), -np.inf)
        for lo in range(0, len(used), 1024):
            rows = used[lo : lo + 1024]
            types, grams, at, places = _batch(t, index[rows])
            score[rows] = model.forward(model.inputs(ids[types], grams, at), places, size[rows])
        best = np.full(int(docs.max()) + 1, -np.inf)
        np.maximum.at(best, docs, score)
        chosen = used[(labels[used] < 0.5) | (score[used] >= best[docs[used]] - 1.0)]
    model._adam = {}
    return model


def _learn_all(model: Model, texts: pa.Array, labels: np.ndarray, rng: np.random.Generator, times: int) -> int:
    """Whole texts in windows that tile them, learned from ``times`` times; of a toxic text only the windows that score highest. The number of windows."""
    t = tokens(texts)
    doc, start, size = spans(t.first, step=WINDOW)
    if not len(doc):
        return 0
    ids, last = model.word_ids(t.hash), len(t.token) - 1

    def index(rows: np.ndarray) -> np.ndarray:
        return t.token[np.minimum(start[rows][:, None] + np.arange(WINDOW), last)]

    score, best = np.zeros(len(doc)), np.full(len(labels), -np.inf)
    toxic = np.flatnonzero(labels[doc] > 0.5)
    for lo in range(0, len(toxic), 1024):
        rows = toxic[lo : lo + 1024]
        types, grams, at, places = _batch(t, index(rows))
        score[rows] = model.forward(model.inputs(ids[types], grams, at), places, size[rows])
    np.maximum.at(best, doc, score)
    chosen = np.flatnonzero((labels[doc] < 0.5) | (score >= best[doc] - 1.0))
    step = min(SHARD_BATCH, max(BATCH, len(chosen) // 16))
    for _ in range(times):
        order = rng.permutation(chosen)
        for lo in range(0, len(order), step):
            rows = order[lo : lo + step]
            types, grams, at, places = _batch(t, index(rows))
            own = np.where(rng.random(len(types)) < 0.1, 0, ids[types])
            model.learn(own, grams, at, places, size[rows], labels[doc[rows]], SHARD_RATE)
    return len(chosen)


def _trained(start: Model, times: int):
    """(shard, label, text), a shard's rows together -> its parameters in rows of ``BLOCK`` numbers, with the windows it learned from."""

    def rows(shard: int, model: Model, many: int) -> pa.RecordBatch:
        flat = np.concatenate([model.p[k].ravel() for k in sorted(model.p)]).astype(np.float32)
        parts = [flat[lo : lo + BLOCK].tobytes() for lo in range(0, len(flat), BLOCK)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(np.full(len(parts), shard)), pa.array(np.full(len(parts), many)), pa.array(parts, pa.binary())], names=["block", "shard", "many", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, model, many, rng = None, None, 0, None
        for whole in batches:
            for batch in slices(whole, 2, HELD_WINDOWS * WINDOW * 6):
                of = batch.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(of)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(of)], strict=True):
                    if of[lo] != shard:
                        if many:
                            yield rows(shard, model, many)
                        shard, many, rng = int(of[lo]), 0, np.random.default_rng([SEED, int(of[lo])])
                        model = Model(start.vocabulary, {k: v.copy() for k, v in start.p.items()})
                    many += _learn_all(model, batch.column(2).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_numpy().astype(np.float32), rng, times)
        if many:
            yield rows(shard, model, many)

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parameters, those of a block together -> their mean, weighted by windows."""
    block, total, weight = None, None, 0

    def mean() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["block", "part"])

    for batch in batches:
        for b, many, part in zip(*(batch.column(k) for k in ("block", "many", "part")), strict=True):
            if b.as_py() != block:
                if block is not None:
                    yield mean()
                block, total, weight = b.as_py(), 0.0, 0
            total = total + many.as_py() * np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
            weight += many.as_py()
    if block is not None:
        yield mean()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> hashes of words with the number of texts that they stand in."""
    for whole in batches:
        for batch in slices(whole, 0, 8 * _SLICE):
            w = Words(batch.column(0))
            types, token = np.unique(w.hash, return_inverse=True)
            once = np.unique(token * np.int64(batch.num_rows) + w.doc) // batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(types.view(np.int64)), pa.array(np.bincount(once, minlength=len(types)))], names=["word", "many"])


def best_threshold(scores: np.ndarray, labels: np.ndarray, many: np.ndarray | None = None) -> float:
    """Middle of the widest gap between scores among those with the best F1; ``many``: how often each score and label occur."""
    order = np.argsort(-scores, kind="stable")
    s, y, n = scores[order], labels[order], np.ones(len(order), np.int64) if many is None else many[order]
    hits = np.cumsum(y * n)
    f1 = 2 * hits / (np.cumsum(n) + hits[-1])
    gap = s - np.append(s[1:], s[-1] - 1e-3)
    f1[gap <= 0] = -1
    top = np.flatnonzero(f1 >= f1.max() - 0.005)
    k = top[np.argmax(gap[top])]
    return float(s[k] - gap[k] / 2)


def _sampled(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(id, label, text) -> texts of at most ``most`` windows of each, spread over it."""
    for whole in batches:
        for batch in slices(whole, 2, _SLICE):
            w = Words(batch.column(2))
            doc, start, size = spans(w.first)
            many = np.bincount(doc, minlength=batch.num_rows)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            step = np.maximum(1.0, many / most)[doc]
            pick = np.flatnonzero(np.floor(nth / step) != np.floor((nth - 1) / step))
            texts = [bytes(w.raw[w.start[start[k]] : w.end[start[k] + size[k] - 1]]).decode() for k in pick]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[pick])), batch.column(1).take(pa.array(doc[pick])), pa.array(texts, pa.string())], names=["id", "label", "text"])


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, _SLICE):
                n = batch.num_rows
                best, many, at = np.full(n, -np.inf), np.zeros(n, np.int32), np.zeros(n, np.int32)
                if model is not None:
                    doc, start, logit = model.windows(batch.column(1))
                    np.maximum.at(best, doc, logit)
                    many = np.bincount(doc, minlength=n).astype(np.int32)
                    hit = np.flatnonzero(logit >= best[doc] - TIE)[::-1]
                    at[doc[hit]] = start[hit]
                none = many == 0
                probability = np.round(_sigmoid(np.where(none, 0, best)), 6)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(many), pa.array(at, pa.int32(), mask=none), pa.array(probability, mask=none), pa.array(~none & (best >= (model.threshold if model else 0)))],
                    names=["doc_id", "n_windows", "worst_at", "score", "toxic"],
                )

    return run


SCORED = "doc_id bigint, n_windows int, worst_at int, score double, toxic boolean"


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, held_out: int = HELD_OUT, sampled: int = SAMPLED_WINDOWS) -> Model | None:
    """A model from all labelled documents; None where it would know one class only."""
    own = labels.where(F.col(quoted(id_col)).isNotNull() & F.col(quoted(label_col)).isNotNull()).groupBy(F.col(quoted(id_col)).cast("bigint").alias("id")).agg(F.max((F.col(quoted(label_col)) > 0).cast("int")).alias("label"))
    own = own.withColumn("held", F.expr(f"pmod(xxhash64(id, {SEED}), {held_out}) = 0"))
    counts = {(r["label"], r["held"]): r["count"] for r in own.groupBy("label", "held").count().collect()}
    if {c for c, _ in counts} != {0, 1}:
        return None
    if {c for c, h in counts if not h} != {0, 1}:
        own, counts = own.withColumn("held", F.lit(False)), {(c, False): sum(counts.get((c, h), 0) for h in (False, True)) for c in (0, 1)}
    small = sum(counts.values()) <= BROADCAST  # beyond that Spark chooses, and may shuffle the documents
    plain = docs.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(text_col)).alias("text")).where("text IS NOT NULL")
    known = plain.join(F.broadcast(own) if small else own, "id")
    learned = known.where("NOT held")
    words = learned.select("text").mapInArrow(_frequencies, "word bigint, many bigint").groupBy("word").agg(F.sum("many").alias("many")).where(F.col("many") >= LEAST_DOCS)
    vocabulary = np.sort(np.array([r["word"] for r in words.orderBy(F.desc("many"), "word").limit(VOCABULARY).collect()], np.int64).view(np.uint64))
    # the start
    few = [own.where((F.col("label") == c) & ~F.col("held")).orderBy(F.xxhash64("id"), "id").limit(n).select("id") for c, n in ((1, toxic_docs), (0, clean_docs))]
    first = learned.join(F.broadcast(few[0].union(few[1])), "id").select("id", "label", "text")  # bounded
    rows = first.mapInArrow(lambda batches: _sampled(batches, sampled), "id bigint, label int, text string").orderBy("id", "text").collect()
    if {r["label"] for r in rows} != {0, 1}:
        return None
    _, docs_of = np.unique([r["id"] for r in rows], return_inverse=True)
    model = train([r["text"] for r in rows], docs_of, np.array([r["label"] for r in rows], np.float32), vocabulary)
    # all of them
    many = sum(n for (_, h), n in counts.items() if not h)
    shards, times = -(-many // SHARD), max(1, 4 * SHARD // many)  # few documents are gone over more often
    shard = learned.select(F.expr(f"CAST(pmod(xxhash64(id, {SEED + 1}), {shards}) AS int)").alias("shard"), "id", "label", "text").repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("id"), "id", "text")
    parts = shard.select("shard", "label", "text").mapInArrow(_trained(model, times), "block bigint, shard bigint, many bigint, part binary")
    mean = parts.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_averaged, "block bigint, part binary").orderBy("block").collect()
    flat, at = np.concatenate([np.frombuffer(r["part"], np.float32) for r in mean]), 0
    for k in sorted(model.p):
        v = model.p[k]
        model.p[k], at = flat[at : at + v.size].reshape(v.shape).copy(), at + v.size
    # equal scores and labels are counted: no more rows than a score has values
    tests = known.where("held").select(F.col("label").cast("bigint").alias("label"), "text").mapInArrow(_scored(model), SCORED).where("score IS NOT NULL").groupBy(F.col("doc_id").alias("label"), "score").count().orderBy("label", "score").collect()
    p = np.clip(np.array([r["score"] for r in tests]), 1e-6, 1 - 1e-6)
    y = np.array([r["label"] for r in tests])
    if len(set(y.tolist())) == 2:
        model.threshold = best_threshold(np.log(p / (1 - p)), y, np.array([r["count"] for r in tests]))
    return model


def scores(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_windows, worst_at`` (word at which the highest window begins), ``score, toxic`` of every document."""
    return docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(_scored(model), SCORED)


def without_toxic(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is toxic, in one pass and without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _scored(model)
        for whole in batches:
            for batch in slices(whole, at, _SLICE):
                ids = pa.array(np.arange(batch.num_rows))
                verdict = next(judge(iter([pa.RecordBatch.from_arrays([ids, batch.column(at)], names=["id", "text"])])))
                yield batch.filter(pa.compute.invert(verdict.column(4)))

    return mapped(docs, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
