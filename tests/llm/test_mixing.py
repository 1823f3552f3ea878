from collections import Counter

import pytest

from turnstone.llm import mixing


def drawn(df):
    return Counter((r.doc_id, r.source) for r in df.collect())


def test_copies_are_floor_or_ceiling(spark):
    rows = [(k, f"t{k}", "big" if k % 4 else "small", 10 + k % 3) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    got = drawn(mixing.mix_sources(docs, weights={"big": 0.25, "small": 0.75}))
    size = Counter()
    for _, _, s, n in rows:
        size[s] += n
    for s, w in (("big", 0.25), ("small", 0.75)):
        each = w * sum(size.values()) / size[s]
        counts = [got[k, t] for k, _, t, _ in rows if t == s]
        assert all(int(each) <= c <= int(each) + 1 for c in counts)
        assert abs(sum(counts) - each * len(counts)) < 1 + len(counts) * 1e-6


def test_equals_plain_loop(spark):
    import hashlib

    rows = [(k * 7 % 101, f"t{k}", ["a", "b", None][k % 3], k % 5 + 1) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    want, size = Counter(), Counter()
    for _, _, s, n in rows:
        size[s] += n
    total, weight = sum(size.values()), {s: n**0.5 for s, n in size.items()}
    for s in size:
        name = "" if s is None else f"={s}"
        e = int(round(weight[s] / sum(weight.values()) * total / size[s], 6) * mixing.PARTS + 0.5)
        upto = int(hashlib.md5(f"{mixing.SEED}:{name}".encode()).hexdigest()[:8], 16) % mixing.PARTS
        for d, t, _, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[1])):
            want[d, t, s] += (upto + e) // mixing.PARTS - upto // mixing.PARTS
            upto += e
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mix_sources(docs).collect())
    assert got == +want


def test_edges(spark):
    schema = "doc_id bigint, text string, source string, n_chars bigint, __expected int, Copy_No string"
    rows = [(1, "a", None, None, 5, "x"), (1, "a", None, None, 5, "x"), (None, None, "s", 3, None, None), (None, None, "s", -3, None, None), (2, "", "s", 3, 1, "y")]
    docs = spark.createDataFrame(rows, schema)
    out = mixing.mix_sources(docs, copy_col=None)
    assert out.columns == docs.columns
    assert sum(r.source is None for r in out.collect()) == 2  # a source without characters stays as it is
    assert mixing.mix_sources(docs.where("false"), copy_col=None).count() == 0
    assert {r.source for r in mixing.mix_sources(docs, weights={"s": 1.0}, copy_col=None).collect()} == {None, "s"}
    assert mixing.mix_sources(docs.where("source = 's'"), weights={}, copy_col=None).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_same_whatever_the_partitioning(spark, parts):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('t', id) AS text", "concat('s', id % 3) AS source", "id % 9 AS n_chars")
    a = sorted(mixing.mix_sources(docs).collect())
    assert a == sorted(mixing.mix_sources(docs.repartition(parts)).collect())


def test_clashing_names_null_ids_and_ties(spark):
    rows = [(k, f"t{k}", "s", 5, k, k, {"m": k}) for k in range(40)] + [(None, f"n{k}", "s", 5, k, k, {}) for k in range(40)] + [(7, "tie", "s", 5, k, k, {}) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint, copy_no int, `a.b` int, m map<string,int>")
    out = mixing.mix_sources(docs, epochs=2.5)
    assert out.columns == [*docs.columns, "_copy_no"]
    got = Counter((r.text, r.copy_no) for r in out.collect())
    assert set(got) == {(r[1], r[4]) for r in rows} and set(got.values()) == {2, 3} and sum(got.values()) in (249, 250, 251)
    again = Counter((r.text, r.copy_no) for r in mixing.mix_sources(docs.repartition(5), epochs=2.5).collect())
    assert got == again
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_long_and_empty_texts_and_many_ranges(spark, monkeypatch):
    rows = [(k, "x" * 200_000 if k == 3 else "", ["a", "b"][k % 2], 7) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    one = sorted(map(tuple, mixing.mix_sources(docs, epochs=1.3).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 0.01)
    assert one == sorted(map(tuple, mixing.mix_sources(docs, epochs=1.3).collect())) and (3, "x" * 200_000, "b", 7, 1) in one
