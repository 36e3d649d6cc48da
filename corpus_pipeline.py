"""The training-data pipeline: five stages over the documents, each written and read again before the next.

What holds for every stage: a null text counts as empty, texts of any length are read whole, repeated rows are treated
alike, other columns keep their names and values whatever they are called, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from officelake.llm import decontamination, jaccard, mixing, secrets, toxicity
from officelake.llm.common import fold, pinned, table


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models let pass; labels of every fourth document stay unseen.

    Texts without words pass; without labels of both kinds all documents do.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) == 2)
    return toxicity.without_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by shingles of five words, at 80 %.

    Documents without words or without an id are in no group and stay.
    """
    return jaccard.representatives(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, word for word or with other values; those without an id stay.

    Null and empty items are held by nothing.
    """
    return decontamination.without_matches(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars set right; null texts stay null."""
    return secrets.redacted(docs, secrets.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for; null is a source, texts without words weigh nothing."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("toxicity", clean_of_toxic),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
]

#: Trained models and components of links have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
