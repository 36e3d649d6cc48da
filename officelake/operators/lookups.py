"""Joins and lookups. Sides are not hinted: Spark broadcasts one when its measured size allows, and AQE
splits skewed sort-merge partitions."""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from officelake.operators.ordering import ordered_lists

CHUNKS, CHUNK_ROWS = 1000, 20_000  # most chunks of time that intervals are dealt to, starts a chunk has below that
NONE = np.iinfo(np.int64).min  # no number; rows that have it as theirs count as without one
OWN, ENDING, SPANNING, ASKING, ASKING_END = range(5)


def match_back(answers: DataFrame, batch: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Model answers joined to the rows they belong to, and the answers whose key is missing or unknown."""
    matched = batch.join(answers, key, "inner")
    unknown = answers.join(batch.select(key), key, "left_anti")
    return matched, unknown


def attach_children(
    parents: DataFrame,
    children: DataFrame,
    key: str,
    order: list[Column],
    item: Column,
    name: str = "children",
) -> DataFrame:
    """Each parent, once, with the ordered list of its children."""
    lists = ordered_lists(children, [key], order, item, name)
    out = parents.join(lists, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def subtype(base: DataFrame, sub: DataFrame, discriminator: str, value: str, key: str = "id") -> DataFrame:
    """Rows of one subtype with the columns of the base table."""
    return base.where(F.col(discriminator) == value).join(sub, key, "inner")


def polymorphic(base: DataFrame, discriminator: str, subs: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Every base row with the columns of its own subtype as one struct column per subtype."""
    out = base
    for value, sub in subs.items():
        fields = F.struct(*[c for c in sub.columns if c != key]).alias(value)
        out = out.join(sub.select(key, fields), key, "left")
        out = out.withColumn(value, F.when(F.col(discriminator) == value, F.col(value)))
    return out


def query_per_row(
    source: DataFrame, target: DataFrame, condition: Callable[[DataFrame, DataFrame], Column]
) -> DataFrame:
    """For each source row every target row its query selects; an equality keeps this a hash or merge join."""
    return source.join(target, condition(source, target), "inner")


def first_match(items: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row in scan order for each external key."""
    rest = [c for c in items.columns if c != key]
    best = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*")


def unique_match(items: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs exactly once."""
    rest = [c for c in items.columns if c != key]
    one = items.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    return one.where(F.col("_n") == 1).select(key, "_r.*")


def overlay(base: DataFrame, top: DataFrame, key: str, value: str) -> DataFrame:
    """Union of keys; a key in ``top`` wins even when its value is null."""
    t = top.select(key, F.col(value).alias("_top"), F.lit(True).alias("_has"))
    out = base.select(key, value).join(t, key, "full_outer")
    return out.select(key, F.when(F.col("_has"), F.col("_top")).otherwise(F.col(value)).alias(value))


def overlay_maps(base: Column, top: Column) -> Column:
    """Two parameter maps in one, the entries of ``top`` winning."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k))
    return F.map_concat(kept, top)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    mine: tuple[str, str],
    theirs: tuple[str, str],
    keys: list[str] | None = None,
    width: int = 1,
    last_of: str | None = None,
) -> DataFrame:
    """(left, right): all pairs of rows, as structs, whose closed intervals of whole numbers overlap, with equal ``keys``.

    ``mine`` and ``theirs`` name start and end. An interval lies in one or two bins of its own length, rounded up to a
    power of two times ``width``, and of each larger length; two intervals meet in a bin as large as the longer one, the
    first they share. So this is an equality join whatever the lengths, and a row has at most two entries per power.
    Intervals with a null, or that end before they start, meet nothing. Few bytes can make many pairs, so the bins are
    dealt over a fixed number of tasks rather than as many as their bytes ask for.

    Pairs grow with the square of how many intervals lie at one time. With ``last_of``, a column of whole numbers on the
    right, they are counted rather than listed (without ``keys``): (left, met, last) with the number of pairs of a left
    row and the greatest number among their right rows. A left row may come up to three times, with pairs of its own
    each, so ``met`` is summed and the greatest ``last`` taken by whoever groups them.
    """
    if last_of is not None:
        if keys:
            raise ValueError("pairs are counted without keys only")
        return _met(left, right, mine, theirs, last_of)
    keys = keys or []
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sized(df: DataFrame, ends: tuple[str, str], name: str) -> DataFrame:
        start, end = (F.col(c).cast("long") for c in ends)
        rows = df.where(start <= end).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct("*").alias(name), start.alias(f"_s_{name}"), end.alias(f"_e_{name}"))
        level = F.ceil(F.log2((F.col(f"_e_{name}") - F.col(f"_s_{name}") + 1) / width))
        return rows.withColumn(f"_l_{name}", F.greatest(level, F.lit(0)).cast("int"))

    a, b = sized(left, mine, "left"), sized(right, theirs, "right")
    tops = [df.agg(F.max(f"_l_{n}")).first()[0] for df, n in ((a, "left"), (b, "right"))]
    top = max([t for t in tops if t is not None], default=0)

    def binned(df: DataFrame, name: str) -> DataFrame:
        every = df.withColumn("_level", F.explode(F.sequence(F.col(f"_l_{name}"), F.lit(top))))
        size = F.lit(width) * F.pow(F.lit(2), F.col("_level")).cast("long")
        first, last = (F.floor(F.col(f"_{c}_{name}") / size) for c in "se")
        return every.withColumn(f"_f_{name}", first).withColumn("_bin", F.explode(F.sequence(first, last)))

    on = [*[f"_k{i}" for i in range(len(keys))], "_level", "_bin"]
    both = binned(a, "left").repartition(tasks, *on).join(binned(b, "right").repartition(tasks, *on), on)
    met = (
        (F.col("_level") == F.greatest("_l_left", "_l_right"))
        & (F.col("_bin") == F.greatest("_f_left", "_f_right"))
        & (F.col("_s_left") <= F.col("_e_right"))
        & (F.col("_s_right") <= F.col("_e_left"))
    )
    return both.where(met).select("left", "right")


def _met(left: DataFrame, right: DataFrame, mine: tuple[str, str], theirs: tuple[str, str], of: str) -> DataFrame:
    """(left, met, last) without a row per pair: time is cut in chunks of about as many starts.

    A left interval meets right ones that start before its chunk, in it, in chunks it spans, and in the one it ends in.
    So every interval goes to the chunk it starts in and the one it ends in; what spans a whole chunk, or starts in one
    that is spanned, comes as one sum per chunk. Both sides take two rows an interval at most, however many meet.
    """

    def ends(df: DataFrame, cols: tuple[str, str], *more: Column) -> DataFrame:
        start, end = (F.col(c).cast("long") for c in cols)
        return df.where(start <= end).select(start.alias("_s"), end.alias("_e"), *more)

    asking = ends(left, mine, F.struct(*left.columns).alias("left"))
    given = ends(right, theirs, F.coalesce(F.col(of).cast("long"), F.lit(NONE)).alias("_v"))
    shares = F.array(*[F.lit(i / CHUNKS) for i in range(1, CHUNKS)])
    starts = asking.select("_s").union(given.select("_s"))
    n, cuts = starts.agg(F.count("*"), F.percentile_approx("_s", shares, F.lit(2 * CHUNKS))).first()
    wanted = min(CHUNKS, -(-n // CHUNK_ROWS))
    cuts = np.array(sorted({cuts[CHUNKS * i // wanted - 1] for i in range(1, wanted)}), dtype=np.int64)

    @F.pandas_udf("int")
    def chunk(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, at.to_numpy(), side="right").astype(np.int32))

    asking, given = (df.withColumns({"_c": chunk("_s"), "_d": chunk("_e")}) for df in (asking, given))
    between = F.explode(F.sequence(F.col("_c") + 1, F.col("_d") - 1)).alias("_at")
    long_ = F.col("_d") > F.col("_c") + 1
    sums = [F.sum("_n").alias("_n"), F.max("_v").alias("_v")]
    counted = given.groupBy("_c", "_d").agg(F.count("*").alias("_n"), F.max("_v").alias("_v"))  # a row per two chunks at most
    spanning = counted.where(long_).select(between, "_n", "_v").groupBy("_at").agg(*sums)

    def rows(df: DataFrame, first: int, second: int) -> DataFrame:
        to = [F.struct(F.col(c).alias("_at"), F.lit(k).alias("_kind")) for c, k in (("_c", first), ("_d", second))]
        return df.withColumn("_to", F.explode(F.when(F.col("_d") > F.col("_c"), F.array(*to)).otherwise(F.array(to[0])))).select("_to.*", *df.columns)

    parts = [rows(given, OWN, ENDING), spanning.withColumn("_kind", F.lit(SPANNING)), rows(asking, ASKING, ASKING_END)]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    both = both.select("_at", "_kind", "_n", "_v", "_s", "_e", "left")
    out = T.StructType([asking.schema["left"], T.StructField("met", T.LongType()), T.StructField("last", T.LongType())])
    near = both.groupBy("_at").applyInArrow(_met_in_chunk, out)
    # chunks that left intervals span: one sum per two chunks
    spans = asking.where(long_).select("_c", "_d").distinct().select("_c", "_d", between)
    whole = counted.groupBy(F.col("_c").alias("_at")).agg(*sums)
    spans = spans.join(whole, "_at").groupBy("_c", "_d").agg(*sums)
    far = asking.where(long_).join(spans, ["_c", "_d"]).select("left", F.col("_n").alias("met"), F.nullif("_v", F.lit(NONE)).alias("last"))
    return near.union(far)


def _met_in_chunk(table: pa.Table) -> pa.Table:
    """Counts and greatest numbers for the left rows of one chunk."""
    kind = table["_kind"].to_numpy()

    def column(name: str, which: np.ndarray) -> np.ndarray:
        return table[name].take(pa.array(which)).to_numpy() if len(which) else np.empty(0, np.int64)

    at = [np.flatnonzero(kind == k) for k in range(5)]
    start, end, number = (column(c, at[OWN]) for c in ("_s", "_e", "_v"))
    by = np.argsort(start, kind="stable")
    start, end, number = start[by], end[by], number[by]
    ends = np.sort(end)

    low, high = column("_s", at[ASKING]), column("_e", at[ASKING])
    before = np.searchsorted(start, high, side="right")  # own ones that start in time, less those that end too early
    met = before - np.searchsorted(ends, low)
    last = _greatest(end, number, before, low)
    late, theirs = column("_e", at[ENDING]), column("_v", at[ENDING])
    by = np.argsort(late, kind="stable")
    late, theirs = late[by], np.append(np.maximum.accumulate(theirs[by][::-1])[::-1], NONE)
    found = np.searchsorted(late, low)
    met, last = met + len(late) - found, np.maximum(last, theirs[found])
    for n, v in zip(column("_n", at[SPANNING]), column("_v", at[SPANNING])):
        met, last = met + n, np.maximum(last, v)

    started = np.searchsorted(start, column("_e", at[ASKING_END]), side="right")
    first = np.append(NONE, np.maximum.accumulate(number))
    met, last = np.append(met, started).astype(np.int64), np.append(last, first[started]).astype(np.int64)
    left = table["left"].take(pa.array(np.append(at[ASKING], at[ASKING_END])))
    out = pa.table({"left": left, "met": pa.array(met), "last": pa.array(last, mask=last == NONE)})
    return out.filter(pa.array(met > 0))


def _greatest(end: np.ndarray, number: np.ndarray, before: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each question the greatest number among its first ``before`` rows whose ``end`` is ``low`` or more.

    The first rows are cut in blocks of powers of two, each sorted by end with the greatest number from there on.
    """
    ends, out = np.sort(end), np.full(len(low), NONE)
    rank, least = np.searchsorted(ends, end), np.searchsorted(ends, low)
    size, far = 1, len(end) + 1
    while size <= len(end):
        blocks = len(end) // size
        rank, number = rank[: blocks * size].reshape(blocks, size), number[: blocks * size].reshape(blocks, size)
        by = np.argsort(rank, axis=1, kind="stable")  # two sorted halves each
        rank, number = np.take_along_axis(rank, by, 1), np.take_along_axis(number, by, 1)
        ask = np.flatnonzero(before & size)
        block = before[ask] // (2 * size) * 2
        place = np.searchsorted((np.arange(blocks)[:, None] * far + rank).ravel(), block * far + least[ask])
        hit = place < (block + 1) * size
        onward = np.maximum.accumulate(number[:, ::-1], axis=1)[:, ::-1].ravel()
        out[ask[hit]] = np.maximum(out[ask[hit]], onward[place[hit]])
        rank, number, size = rank.ravel(), number.ravel(), 2 * size
    return out
