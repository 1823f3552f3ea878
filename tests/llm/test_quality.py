import duckdb
import pytest

from turnstone.llm import quality

SCHEMA = "doc_id bigint, text string, source string"
CLEAN = "This is an ordinary sentence of some length, followed by another one that says nothing new. "
BAD = {
    "symbols": "a$$$ b%%% c### d&&& e*** f!!! g$$$ h%%% i### j&&& k***",
    "upper_case": "ALL OF THIS IS WRITTEN IN CAPITALS FOR NO GOOD REASON AT ALL",
    "digits": "11111 22222 33333 44444 55555 66666 77777 88888 99999 12345 words",
    "repeats": "again again again again again again again then then then then then",
    "diversity": "one two three four five six seven " * 20,
    "word_length": "a b c d e f g h i j k l",
    "lines": "same line\nsame line\nsame line\nsame line\nsame line",
    "empty": "  \n ",
}


@pytest.mark.parametrize("rule", BAD)
def test_each_rule(spark, rule):
    r = quality.rule_failures(spark.createDataFrame([(1, BAD[rule], "s"), (2, CLEAN, "s"), (3, "Short.", None)], SCHEMA)).orderBy("doc_id").collect()
    assert rule in r[0].rules.split(",") and r[1].failed == r[2].failed == 0 and r[2].host == ""


def test_hosts_shrink_and_set_the_bar(spark):
    rows = [(k, CLEAN, "https://Good.org/a") for k in range(600)] + [(1000, BAD["symbols"], "http://good.org/b")]
    rows += [(2000 + k, BAD["symbols"] if k % 10 else CLEAN, "bad.net") for k in range(200)]
    rows += [(3000, BAD["lines"], "tiny.com"), (3001, CLEAN, "tiny.com")]
    got = {r.doc_id: r for r in quality.host_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].host == "good.org" and got[0].host_verdict == "trust" and got[1000].keep
    assert got[2001].host_verdict == "reject" and not got[2001].keep and got[2000].keep
    assert not got[3000].keep and 0 < got[3000].host_rate < 1 and got[3000].host_failed == 1
    assert all(r.keep for r in got.values() if r.failed == 0)


def test_edges_and_sql(spark):
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "", "s", 2), (2, CLEAN, "s", 3), (3, BAD["digits"] + "\u000b é", "HTTP://S.org:80/x?y", 4)]
    docs = spark.createDataFrame(rows, SCHEMA + ", host int").selectExpr("*", "1 AS n", "2 AS r", "3 AS `a.b`")
    got = sorted(map(tuple, quality.host_verdicts(docs).collect()), key=repr)
    pdf = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    cur = c.execute(quality.SQL)
    names = [x[0] for x in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    cols = quality.host_verdicts(docs).columns
    assert got == sorted((tuple(w[k] for k in cols) for w in want), key=repr)
    assert quality.host_verdicts(docs.where("false")).count() == 0


def test_long_texts_and_rates_that_tie(spark):
    rows = [(1, CLEAN * 3000, "s"), (2, BAD["lines"] * 3000, "s"), (3, CLEAN, "t")]
    got = {r.doc_id: r for r in quality.host_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "diversity" in got[1].rules and "repeats" not in got[1].rules and not got[2].keep
    rate = got[1].host_rate
    for bounds in ({"reject": rate}, {"reject": 1.0, "trust": rate}):
        assert quality.host_verdicts(spark.createDataFrame(rows, SCHEMA), **bounds).where("host = 's'").first().host_verdict == "ordinary"
