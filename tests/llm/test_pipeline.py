import random

import corpus_pipeline as C
import numpy as np
import pyarrow as pa
import pytest

from turnstone.llm import bpe, mixing, pii, toxicity

from .test_simhash import brute_groups


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents and labels as tables: toxic ones, near copies, personal data, one source that is half of all."""
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(1500)]
    rows, labels = [], []
    for k in range(360):
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice([8, 60, 150]))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(1 + len(w) // 30):
                w[rnd.randrange(len(w))] = rnd.choice(["idiot", "moron", "scum"])
        if k % 5 == 1:
            w.insert(3, f"bob.{k}@mail.example.com")
        rows.append((k, " ".join(w), "en", "big" if k % 2 else f"s{k % 4}", 0))
        labels.append((k, 1, int(toxic)))
    for k in range(1, 120, 6):
        w = rows[k][1].split()
        w[0] = "changed"
        rows.append((1000 + k, " ".join(w), "en", "big", 0))
    rows += [(2000, None, "en", "big", None), (2001, "", None, None, 0), (5, rows[5][1], "en", "big", 0), (None, "a text without an id", "en", "big", 20)]
    rows = [(i, t, lang, s, len(t) if t is not None and i is not None else n) for i, t, lang, s, n in rows]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages_are_as_dealt():
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash near-dedup", "pii", "mixing", "bpe"] and C.ORACLE_SQL is None


def test_against_brute_force(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns

    first = C.drop_toxic(spark, docs, folder)
    assert first.columns == names
    one = [tuple(r) for r in first.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    verdict = {}
    for i, t, *_ in rows:  # each text alone, window by window
        logit = model.windows(pa.array([t], pa.string()))[2]
        verdict[i, t] = len(logit) > 0 and logit.max() >= model.threshold
    assert sorted(one, key=repr) == sorted((r for r in rows if not verdict[r[0], r[1]]), key=repr)
    bad = {r[0] for r in rows if r[1] and any(b in r[1].split() for b in ("idiot", "moron", "scum"))}
    kept = {r[0] for r in one}
    assert len(bad & kept) <= 0.1 * len(bad) and len({r[0] for r in rows} - bad - kept) <= 0.05 * len(rows)

    docs = spark.createDataFrame(one, docs.schema)
    second = C.drop_near_duplicates(spark, docs, folder)
    assert second.columns == names
    two = [tuple(r) for r in second.collect()]
    label, _ = brute_groups([r[1] for r in one])
    survivors = [min((one[k][0] is None, one[k][0] or 0) for k in np.flatnonzero(label == g)) for g in np.unique(label)]
    assert sorted((r[0] is None, r[0] or 0) for r in two) == sorted(survivors)

    third = C.redact_pii(spark, spark.createDataFrame(two, docs.schema), folder)
    assert third.columns == names
    three = [tuple(r) for r in third.collect()]
    want = []
    for i, t, lang, s, n in two:
        hits = pii.find(t) if t else []
        u = pii.redact(t, hits) if hits else t
        want.append((i, u, lang, s, len(u) if hits else n))
    assert sorted(three, key=repr) == sorted(want, key=repr) and any("<email>" in (r[1] or "") for r in three)
    assert not any("@mail" in (r[1] or "") for r in three)

    fourth = C.mix(spark, spark.createDataFrame(three, docs.schema), folder)
    assert fourth.columns == names
    four = [tuple(r) for r in fourth.collect()]
    assert set(four) <= set(three) and len(four) > len(three) / 2
    counted = mixing.mix_sources(spark.createDataFrame(three, docs.schema)).count()
    assert len(four) == counted

    fifth = C.tokenize(spark, spark.createDataFrame(four, docs.schema), folder).collect()
    enc = bpe.Encoder(bpe.load_ranks(bpe.VOCABULARY), bpe.lookahead_of(bpe.VOCABULARY))
    got = sorted(((r.doc_id, r.tokens) for r in fifth), key=repr)
    assert got == sorted(((r[0], None if r[1] is None else enc.encode(r[1])) for r in four), key=repr) and all(r.round_trip for r in fifth)


def test_run(spark, corpus):
    folder, rows = corpus
    out = C.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "tokens", "round_trip"]
    assert 0 < out.count() < 2 * len(rows) and out.where("NOT round_trip").count() == 0


def test_empty_table_and_other_columns(spark, corpus, tmp_path):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS score", "2 AS signature", "3 AS copy_no", "4 AS __id", "5 AS `a.b`")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
        out = stage(spark, docs.limit(20), folder)
        assert out.columns == docs.columns and out.count() >= 0, name
    assert C.tokenize(spark, docs.where("false"), folder).count() == 0


def test_long_texts_ties_and_repeated_rows(spark, corpus):
    folder, _ = corpus
    long = " ".join(f"word{k} and then" for k in range(60_000)) + " mail bob@mail.example.com"
    rows = [(1, long, "en", "a", len(long)), (2, long, "en", "a", len(long)), (2, long, "en", "a", 5), (None, "only one", None, None, None), (None, "only one", None, None, None), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in C.STAGES[1:]:
        docs = stage(spark, docs, folder).cache()
        if name == "simhash near-dedup":
            assert sorted((r.doc_id or 0, len(r.text)) for r in docs.collect()) == [(0, 8), (1, len(long)), (3, 0)]
    got = {r.doc_id: r for r in docs.collect()}
    assert got[1].round_trip and got[1].n_tokens > 180_000
