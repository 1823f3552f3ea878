"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet in the shared folder, reads it again for the next
and deletes it once that has been written. All but the last keep the columns of
``documents``.

Defined results, for every stage and ``run``: a null or empty text is never
toxic, a near duplicate or personal data; it is mixed like others and has no
tokens (null stays null). A null id is kept and passed on; a null source is a
source of its own. Very long texts are worked on whole. Repeated rows (same id
and text) and all other members of a group of near duplicates but the one of
the least id go in the second stage; of rows that tie in id and text any one
stays. After mixing a document stands there as often as it was drawn. Empty
tables give empty tables with the same columns. Further columns are passed on
whatever their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from turnstone.llm import bpe, mixing, pii, simhash, toxicity
from turnstone.llm.common import delete, shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxic window go. The network learns from ``labels``, which may name documents that are here."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the least id."""
    return simhash.deduplicated(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become ``<kind>``; ``n_chars`` follows."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document is there as often as it is drawn."""
    return mixing.mix_sources(docs, copy_col=None)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with its id, language and source."""
    return bpe.encode_documents(docs, keep=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: The stages before mixing can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        delete(spark, f"{folder}/{k - 1}")
    return docs
