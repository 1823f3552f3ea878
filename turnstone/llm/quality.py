"""Host-level quality rules.

Each document is held against eight rules (``RULES``). Their failures are added
up by host; a host's share of failing documents is shrunk towards the corpus by
a beta prior whose two parameters are estimated from all hosts (method of
moments), so that a host of three pages is not judged on three pages. The
verdict on the host goes back to its documents and sets how many failures they
may have: none on an ordinary or a rejected host, one on a trusted host. A
document without failures always stays.

The host is the host part of ``source`` where that is a URL, else ``source``.

Defined results: null or blank text fails the rule ``empty`` alone; a null
source is the host ``''``; ratios of texts under ten words are not judged; texts
are judged whole whatever their length; a rate that ties with ``reject`` or
``trust`` is ordinary; repeated rows count each; a null id is passed on; an
empty table gives an empty table. Only the named columns are read, so other
columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.common import cut, quoted, table

#: Shrunk failure rates over REJECT condemn a host, those under TRUST make it trusted.
REJECT, TRUST = 0.5, 0.02
#: rule -> condition, in SQL that both engines read; n words, d distinct, a adjacent repeats, ln lines, dl distinct lines, c characters.
RULES = {
    "empty": "n = 0",
    "symbols": "n >= 10 AND sym > 0.08 * c",
    "upper_case": "n >= 10 AND up > 0.3 * c",
    "digits": "n >= 10 AND dig > 0.3 * c",
    "repeats": "n >= 10 AND a > 0.2 * (n - 1)",
    "diversity": "n >= 50 AND d < 3 * sqrt(n)",
    "word_length": "n >= 10 AND (wc < 2.5 * n OR wc > 14 * n)",
    "lines": "ln >= 4 AND dl < 0.5 * ln",
}
_FAILED = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in RULES.values())
_NAMES = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in RULES.items())

_HOSTS = """
, h AS (
  SELECT host, count(*) AS host_docs, sum(CASE WHEN failed > 0 THEN 1 ELSE 0 END) AS host_failed FROM r GROUP BY host
), m AS (
  SELECT CAST(sum(host_failed) AS DOUBLE) / sum(host_docs) AS mu, avg(host_failed * 1.0D / host_docs) AS m1, avg((host_failed * 1.0D / host_docs) * (host_failed * 1.0D / host_docs)) AS m2, avg(1.0D / host_docs) AS inv FROM h
), v AS (
  SELECT mu, m2 - m1 * m1 - mu * (1 - mu) * inv AS between_hosts FROM m
), p AS (
  SELECT mu, CASE WHEN between_hosts > 1e-6 THEN greatest(mu * (1 - mu) / between_hosts - 1, 1) ELSE 1000.0D END AS strength FROM v
), x AS (
  SELECT host, host_docs, host_failed, round((host_failed + mu * strength) / (host_docs + strength), 6) AS host_rate FROM h CROSS JOIN p
), y AS (
  SELECT *, CASE WHEN host_rate > {reject} THEN 'reject' WHEN host_rate < {trust} THEN 'trust' ELSE 'ordinary' END AS host_verdict FROM x
)
SELECT r.doc_id, r.host, r.failed, r.rules, y.host_docs, y.host_failed, y.host_rate, y.host_verdict,
       r.failed <= CASE WHEN y.host_verdict = 'trust' THEN 1 ELSE 0 END AS keep
FROM r JOIN y ON r.host = y.host
"""


def _hosts(reject: float, trust: float) -> str:
    return _HOSTS.format(reject=reject, trust=trust)


def rule_failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, host, failed, rules``: what each document fails, in one pass over its text."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    plain = docs.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("t"), F.coalesce(F.col(quoted(source_col)).cast("string"), F.lit("")).alias("s"))
    flat = plain.select("doc_id", "s", "t", F.split(F.trim(F.regexp_replace("t", "[ \t\r\n]+", " ")), " ").alias("w"), F.split("t", "\n").alias("l"))
    counts = flat.select(
        "doc_id",
        F.expr("lower(CASE WHEN s RLIKE '^[A-Za-z][A-Za-z0-9+.-]*://' THEN regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) ELSE s END)").alias("host"),
        F.expr("CASE WHEN w[0] = '' THEN 0 ELSE size(w) END").alias("n"),
        F.expr("size(array_distinct(w))").alias("d"),
        F.expr("size(filter(w, (x, i) -> i > 0 AND x = w[greatest(i - 1, 0)]))").alias("a"),
        F.expr("char_length(t)").alias("c"),
        F.expr("char_length(array_join(w, ''))").alias("wc"),
        F.expr("char_length(t) - char_length(regexp_replace(t, '[!-/:-@\\\\[-`{-~]', ''))").alias("sym"),
        F.expr("char_length(t) - char_length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))").alias("up"),
        F.expr("char_length(t) - char_length(translate(t, '0123456789', ''))").alias("dig"),
        F.expr("size(l)").alias("ln"),
        F.expr("size(array_distinct(l))").alias("dl"),
    )
    return counts.select("doc_id", "host", F.expr(_FAILED).alias("failed"), F.expr(f"concat_ws(',', {_NAMES})").alias("rules"))


def host_verdicts(docs: DataFrame, *, reject: float = REJECT, trust: float = TRUST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: its failures, its host's shrunk rate and verdict, and whether it stays."""
    failures = cut(rule_failures(docs, id_col=id_col, text_col=text_col, source_col=source_col))  # used twice; the text is read once
    return docs.sparkSession.sql("WITH r AS (SELECT * FROM {r}) " + _hosts(reject, trust), r=failures)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_verdicts(table(spark, sf_dir, "documents"))


SQL = (
    f"""
WITH f AS (
  SELECT doc_id, lower(CASE WHEN regexp_matches(s, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) ELSE s END) AS host, t,
         string_split(trim(regexp_replace(t, '[ \t\r\n]+', ' ', 'g')), ' ') AS w, string_split(t, chr(10)) AS l
  FROM (SELECT doc_id, coalesce(source, '') AS s, coalesce(text, '') AS t FROM documents)
), k AS (
  SELECT doc_id, host, CASE WHEN w[1] = '' THEN 0 ELSE len(w) END AS n, len(list_distinct(w)) AS d,
         len(list_filter(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: p[1] = p[2])) AS a,
         length(t) AS c, length(array_to_string(w, '')) AS wc,
         length(t) - length(regexp_replace(t, '[!-/:-@\\[-`{{-~]', '', 'g')) AS sym,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS dig,
         len(l) AS ln, len(list_distinct(l)) AS dl
  FROM f
), r AS (
  SELECT doc_id, host, CAST({_FAILED} AS INTEGER) AS failed, concat_ws(',', {_NAMES}) AS rules FROM k
)"""
    + _hosts(REJECT, TRUST)
    .replace("1000.0D", "CAST(1000 AS DOUBLE)")
    .replace("1.0D", "CAST(1 AS DOUBLE)")
    .replace("sum(CASE WHEN failed > 0 THEN 1 ELSE 0 END)", "CAST(sum(CASE WHEN failed > 0 THEN 1 ELSE 0 END) AS BIGINT)")
)
