import math
import random

import numpy as np
import pyarrow as pa
import pytest

from turnstone.llm import toxicity as T

BAD = ["idiot", "moron", "scum"]


def corpus(n=400, seed=0):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(600)]
    docs, labels = [], []
    for k in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 40, 150]))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(max(1, len(w) // 40)):
                w[rnd.randrange(len(w))] = rnd.choice(BAD) + rnd.choice(["", "s", "ic"])
        docs.append((k, " ".join(w), "s"))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_gradients():
    rng = np.random.default_rng(0)
    t = T.tokens(pa.array(["alpha beta gamma delta", "beta beta eps"]))
    m = T.Model.new(np.sort(t.hash[:3]))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    index = np.stack([t.token[[0, 1, 2, 3]], t.token[[4, 5, 6, 6]]])
    size, y, ids = np.array([4, 3]), np.array([1.0, 0.0]), m.word_ids(t.hash)

    def loss():
        logit = m.forward(m.inputs(ids, t.grams, t.at).astype(np.float64), index, size)
        return float(np.mean(np.logaddexp(0, np.where(y > 0.5, -logit, logit))))

    before = {k: v.copy() for k, v in m.p.items()}
    seen = {}
    real = np.sqrt
    m.learn(ids, t.grams, t.at, index, size, y, 0.0)
    for k in m.p:
        seen[k] = m._adam[k][0] / 0.1
    m.p = before
    for k in ("xf", "ub", "bf", "attend", "out", "bias", "uf"):
        for at in [tuple(rng.integers(0, n) for n in m.p[k].shape) for _ in range(4)]:
            m.p[k][at] += 1e-4
            up = loss()
            m.p[k][at] -= 2e-4
            down = loss()
            m.p[k][at] += 1e-4
            assert seen[k][at] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=2e-4), (k, at)
    row = ids[t.token[0]]
    m.p["word"][row, 0] += 1e-3
    up = loss()
    m.p["word"][row, 0] -= 2e-3
    assert seen["word"][row, 0] == pytest.approx((up - loss()) / 2e-3, rel=0.1, abs=5e-4)
    assert real is np.sqrt


@pytest.mark.parametrize("n, want", [(0, []), (1, [(0, 1)]), (32, [(0, 32)]), (33, [(0, 32), (1, 32)]), (48, [(0, 32), (16, 32)]), (50, [(0, 32), (16, 32), (18, 32)])])
def test_all_windows(n, want):
    doc, start, size = T.spans(np.array([0, n]))
    assert list(zip(start.tolist(), size.tolist())) == want
    assert set(range(n)) == {k for s, z in want for k in range(s, s + z)}


def test_learns_and_scores(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    model = T.fit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    fresh_docs, fresh_labels = corpus(200, seed=0)
    rnd = random.Random(5)
    rows = []
    for (i, text, s), (_, _, y) in zip(fresh_docs, fresh_labels):
        w = text.split()
        rnd.shuffle(w)
        rows.append((i, " ".join(w), s, y))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, toxic int")
    got = {r.doc_id: r for r in T.scores(table, model).collect()}
    right = [got[i].toxic == bool(y) for i, _, _, y in rows]
    assert np.mean(right) >= 0.97
    # every window counts, wherever in the text it is, and masks change nothing
    clean = " ".join(t for _, t, _ in docs[1:60] if not any(b in t for b in BAD))
    rows = [(1, clean + " idiot moron " + clean, 0), (2, None, 0), (3, "", 0), (4, "?!", 0), (5, "idiot", 0), (5, "idiot", 0), (None, "idiot moron", 0)]
    edge = spark.createDataFrame(rows, "doc_id bigint, text string, score int").selectExpr("*", "1 AS toxic", "2 AS `a.b`")
    r = T.scores(edge, model).collect()
    by = {x.doc_id: x for x in r}
    n = len(clean.split())
    assert by[1].worst_at <= n < by[1].worst_at + T.WINDOW and by[1].n_windows == 1 + -(-(2 * n + 2 - T.WINDOW) // T.STEP)
    assert all(by[k].score is None and not by[k].toxic and by[k].n_windows == 0 for k in (2, 3, 4))
    kept = T.without_toxic(edge, model)
    assert kept.columns == edge.columns and {x.doc_id for x in kept.collect()} >= {2, 3, 4}
    verdict = {x.doc_id: x.toxic for x in r}
    assert {x.doc_id for x in kept.collect()} == {k for k, v in verdict.items() if not v}
    assert T.scores(edge.where("false"), model).count() == 0 == T.without_toxic(edge.where("false"), model).count()


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    for labels in ([], [(1, None)], [(1, 1)], [(7, 0), (8, 1)]):
        assert T.fit(d, spark.createDataFrame(labels, "doc_id bigint, toxic int")) is None
    r = T.scores(d, None).first()
    assert r.score is None and not r.toxic


def test_threshold_is_in_the_gap():
    assert T.best_threshold(np.array([5.0, 4.0, -1.0, -2.0]), np.array([1, 1, 0, 0])) == 1.5


def plain_score(m, words):
    """The network on one window, by loops over its equations."""
    t = T.tokens(pa.array([" ".join(words)]))
    ids, h, xs = m.word_ids(t.hash), T.HIDDEN, []
    for k in t.token:
        grams = t.grams[t.at[k] : t.at[k + 1]]
        xs.append([*map(float, m.p["word"][ids[k]]), *(sum(float(m.p["char"][g, j]) for g in grams) / len(grams) for j in range(T.CHAR_DIM))])
    sig = lambda v: 1 / (1 + math.exp(-v))
    states = [[] for _ in xs]
    for way in "fb":
        w, b, u, state = m.p[f"x{way}"], m.p[f"b{way}"], m.p[f"u{way}"], [0.0] * h
        for k in range(len(xs)) if way == "f" else reversed(range(len(xs))):
            x = [float(b[j]) + sum(v * float(w[i, j]) for i, v in enumerate(xs[k])) for j in range(3 * h)]
            s = [sum(v * float(u[i, j]) for i, v in enumerate(state)) for j in range(3 * h)]
            z, r = [sig(x[j] + s[j]) for j in range(h)], [sig(x[h + j] + s[h + j]) for j in range(h)]
            new = [math.tanh(x[2 * h + j] + r[j] * s[2 * h + j]) for j in range(h)]
            state = [(1 - z[j]) * new[j] + z[j] * state[j] for j in range(h)]
            states[k] = states[k] + state
    a = [math.exp(sum(v * float(w) for v, w in zip(s, m.p["attend"]))) for s in states]
    pooled = [sum(a[k] * states[k][j] for k in range(len(a))) / sum(a) for j in range(2 * h)]
    return float(m.p["bias"][0]) + sum(v * float(w) for v, w in zip(pooled, m.p["out"]))


def test_query_equals_plain_loops(spark):
    """Scores of whole texts against the network's equations, window by window."""
    docs, labels = corpus(120, seed=2)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    m = T.fit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), sampled=2)
    rows = {r.doc_id: r for r in T.scores(d, m).collect()}
    for i, text, _ in docs[:25]:
        w = text.split()
        starts = [0] if len(w) <= T.WINDOW else sorted({*range(0, len(w) - T.WINDOW, T.STEP), len(w) - T.WINDOW})
        each = [plain_score(m, w[k : k + T.WINDOW]) for k in starts]
        p = 1 / (1 + math.exp(-max(each)))
        assert rows[i].n_windows == len(starts) and rows[i].score == pytest.approx(p, abs=2e-4)
        assert each[starts.index(rows[i].worst_at)] == pytest.approx(max(each), abs=1e-3)
        assert abs(max(each) - m.threshold) < 1e-2 or rows[i].toxic == (max(each) >= m.threshold)


def test_long_texts_and_ties(spark):
    docs, labels = corpus(120, seed=2)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    m = T.fit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    long = " ".join(["word"] * 200_000)
    r = T.scores(spark.createDataFrame([(1, long)], "doc_id bigint, text string"), m).first()
    assert r.n_windows == 1 + -(-(200_000 - T.WINDOW) // T.STEP) and r.worst_at == 0
    assert T.without_toxic(spark.createDataFrame([(1, long)], "doc_id bigint, text string"), m).count() == int(not r.toxic)


def test_every_labelled_document_is_learned_from(spark):
    """A word of all toxic documents that the start doesn't see, vocabulary of all documents, weighted threshold."""
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(6)) for _ in range(300)]
    docs = [(k, " ".join([rnd.choice(vocabulary) for _ in range(24)] + (["zqxvjk"] if k % 3 == 0 else ["ordinary"]))) for k in range(600)]
    d, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in docs], "doc_id bigint, toxic int")
    m = T.fit(d, labels, toxic_docs=32, clean_docs=32)
    assert T.tokens(pa.array(["zqxvjk"])).hash[0] in m.vocabulary and len(m.vocabulary) >= 300
    assert np.mean([r.toxic == (r.doc_id % 3 == 0) for r in T.scores(d, m).collect()]) >= 0.95
    assert T.best_threshold(np.array([5.0, -1.0, 4.0]), np.array([1, 0, 0]), np.array([1, 9, 50])) == T.best_threshold(np.array([5.0] + [-1.0] * 9 + [4.0] * 50), np.array([1] + [0] * 59))
