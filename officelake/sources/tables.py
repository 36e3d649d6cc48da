"""Relational scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def query_source(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Rows of a SQL query over the given frames; ``{name}`` in the text stands for a frame."""
    return spark.sql(sql, **frames)


def jdbc_source(
    spark: SparkSession, url: str, query: str, partition_column: str, lower: int, upper: int, partitions: int
) -> DataFrame:
    """Rows of a query in an external database, read in parallel ranges of ``partition_column``."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", f"({query}) q")
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )
