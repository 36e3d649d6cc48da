"""Mailbox scans. Operators take a message table; the search text of a mail server is a Column predicate here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from officelake.operators.ordering import last_wins
from officelake.schemas import MAIL_INDEX

SEARCH_CAP = 500  # fixed value: ids on one search page


def generate_ids(messages: DataFrame, predicate: Column) -> DataFrame:
    """Ids of every matching message."""
    return messages.where(predicate).select("id", "thread_id")


def fetch_ids(
    messages: DataFrame, predicate: Column, order: list[Column], cap: int = SEARCH_CAP
) -> DataFrame:
    """Ids of the first search page. ``order`` must be total, or the page would not be repeatable."""
    return messages.where(predicate).orderBy(*order).limit(cap).select("id", "thread_id")


def search_expand(ids: DataFrame, messages: DataFrame) -> DataFrame:
    """The full message of every id found."""
    return ids.select("id").join(messages, "id", "inner")


def download(ids: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per requested id: the message, or an error for an id that is not there."""
    rest = [c for c in messages.columns if c != "id"]
    found = messages.withColumn("_found", F.lit(True))
    joined = ids.join(found, "id", "left")
    return joined.select(
        "id",
        F.when(F.col("_found"), F.struct(*rest)).alias("value"),
        F.when(F.col("_found").isNull(), F.concat(F.lit("not found: "), F.col("id"))).alias("error"),
    )


def load_index(spark: SparkSession, path: str, array_files: bool = False) -> DataFrame:
    """The saved mail index; a row saved later replaces an earlier one with the same id.

    The index is a folder of JSON-lines files, so that it is read in parallel; ``array_files`` reads files
    that hold one JSON array each. A folder that is missing is an empty index, a broken row an error.
    """
    schema = T.StructType(MAIL_INDEX.fields + [T.StructField("seq", T.LongType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], MAIL_INDEX)
    rows = spark.read.schema(schema).json(path, multiLine=array_files, mode="FAILFAST")
    order = [F.coalesce("seq", F.lit(0)), F.struct(*MAIL_INDEX.fieldNames())]
    return last_wins(rows, ["id"], order).drop("seq")


def load_results(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """Saved results keyed by ``key``; rows without the key are skipped, a missing folder is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST").where(F.col(key).isNotNull())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system its scheme names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
