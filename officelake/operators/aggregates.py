"""Grouped statistics and set reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def stream_statistics(
    items: DataFrame, key: str, failed: Column, sample: Column, order: Column, touched: DataFrame | None = None
) -> DataFrame:
    """Per key the count, the failures and the last sample; keys only touched count 0."""
    out = items.groupBy(key).agg(
        F.count("*").alias("items"),
        F.count_if(failed).alias("errors"),
        F.max_by(sample, order).alias("last_sample"),
    )
    if touched is not None:
        out = touched.select(key).distinct().join(out, key, "full_outer")
        out = out.withColumn("items", F.coalesce("items", F.lit(0))).withColumn(
            "errors", F.coalesce("errors", F.lit(0))
        )
    return out


def id_union(edits: DataFrame, column: str = "origin_ids", name: str = "origin_id") -> DataFrame:
    """Distinct ids over all edits."""
    return edits.select(F.explode(column).alias(name)).distinct()


def missing_ids(inputs: DataFrame, processed: DataFrame, name: str = "origin_id") -> DataFrame:
    """Input ids that no edit accounts for."""
    return inputs.select(name).distinct().join(processed, name, "left_anti")


def action_summary(decisions: DataFrame, column: str = "action") -> DataFrame:
    """How many rows each decision applies to."""
    return decisions.groupBy(column).agg(F.count("*").alias("rows"))


def rows_of_all(*frames: DataFrame) -> DataFrame:
    """Rows of several tables in one; columns a table does not have are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
