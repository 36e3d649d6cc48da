"""Positions, batches and top-n that stay exact when one key holds most of the rows.

Rows are sorted by range over all tasks: each sorted piece numbers its own rows, and the counts of the earlier pieces
are added, so no key has to fit a task. A caller who knows that no key is large (lines of an order) says so with
``bounded`` and gets a plain window instead, without the sort. Nothing is counted to choose between them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from officelake.session import ensure_checkpoints

_ROW_BITS = 33  # monotonically_increasing_id: task number above, row in the task below


def _sorted_pieces(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-sort over all tasks and pin the result, with piece number ``_piece`` and row ``_at``.

    The checkpoint matters: range bounds come from a sample, so a recomputed branch could cut elsewhere.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pinned = (
        df.repartitionByRange(pieces, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint()
    )
    return (
        pinned.withColumn("_piece", F.shiftright("_mid", _ROW_BITS))
        .withColumn("_at", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_mid")
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are left out."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def _split_ordinal(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    pieces = _sorted_pieces(df, [F.col(k) for k in keys] + order)
    # One row per (key, piece): a key only meets several pieces when it is big, so this stays small.
    starts = pieces.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = _join(pieces, starts, [*keys, "_piece"])
    return joined.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def ordinal(df: DataFrame, keys: list[str], order: list[Column], name: str = "ordinal", bounded: bool = False) -> DataFrame:
    """0-based position of every row within its key. ``order`` must be total within a key."""
    if bounded:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    return _split_ordinal(df, keys, order, name)


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, bounded: bool = False
) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including each row."""
    if bounded:
        upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumn(name, F.sum(value).over(upto))
    pieces = _sorted_pieces(df, [F.col(k) for k in keys] + order).withColumn("_v", value)
    sums = pieces.groupBy(*keys, "_piece").agg(F.sum("_v").alias("_s"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    upto = W.partitionBy(*keys, "_piece").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = pieces.withColumn("_in", F.sum("_v").over(upto))
    joined = _join(inside, sums, [*keys, "_piece"])
    return joined.select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


def global_index(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """0-based position over the whole table, by a range sort and per-piece offsets."""
    pieces = _sorted_pieces(df, order)
    sizes = pieces.groupBy("_piece").agg(F.count("*").alias("_n"))
    before = W.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    # One row per piece, so this window is over as many rows as there are shuffle partitions.
    offsets = sizes.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return pieces.join(F.broadcast(offsets), "_piece").select(
        *df.columns, (F.col("_before") + F.col("_at")).alias(name)
    )


def batches(df: DataFrame, order: list[Column], size: int, name: str = "batch") -> DataFrame:
    """Consecutive groups of ``size`` rows in ``order``, one output row each, the last one short."""
    indexed = global_index(df, order, "_index").withColumn(name, F.expr(f"_index div {int(size)}"))
    item = F.struct("_index", *df.columns)
    return (
        indexed.groupBy(name)
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .withColumn("items", F.transform("items", lambda i: i.dropFields("_index")))
    )


def ordered_lists(df: DataFrame, keys: list[str], order: list[Column], item: Column, name: str = "items") -> DataFrame:
    """One row per key with the list of its items in ``order``, which must be total within a key.

    A list is one value of one row, so its key's items meet in one task; where only positions are wanted, ``ordinal``
    gives one row per item instead.
    """
    place = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(place.alias("_o"), item.alias("_item")))).alias(name))
    return lists.withColumn(name, F.transform(name, lambda i: i["_item"]))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: int = 64) -> DataFrame:
    """The first ``n`` rows of every key in ``order``.

    Every key is first cut to ``n`` within each of ``spread`` slices, so the final window sees at most
    ``spread * n`` rows of any key, however many it holds. A slice is a set of tasks, so Spark can cut to
    ``n`` within each task before the first shuffle; which rows make up a slice does not change the result.
    """
    slice_of = F.spark_partition_id() % spread
    first = W.partitionBy(*keys, "_slice").orderBy(*order)
    last = W.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_slice", slice_of)
        .withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(last))
        .where(F.col("_rn") <= n)
        .drop("_slice", "_rn")
    )


def every_nth(df: DataFrame, keys: list[str], order: list[Column], n: int, bounded: bool = False) -> DataFrame:
    """Each n-th row of every key; n = 0 emits nothing."""
    if n <= 0:
        return df.where(F.lit(False))
    return ordinal(df, keys, order, "_pos", bounded).where((F.col("_pos") + 1) % n == 0).drop("_pos")


def last_wins(df: DataFrame, keys: list[str], order: list[Column] | Column) -> DataFrame:
    """One row per key: the one that comes last in ``order`` (a map-side combined aggregate, no window)."""
    rank = F.struct(*order) if isinstance(order, list) else order
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)
