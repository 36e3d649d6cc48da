"""Mixing sources to target weights: tokens per source, repetition rates, whole copies plus one seeded draw."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from officelake.llm.common import WORD_PATTERN, pinned, small_side


def word_count(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def seeded_draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone (52 bits of an MD5)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def numbered_sources(sized: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(source, source_size, weight): weights go round the sources by code point, null last.

    Sources are numbered by range partition: each partition counts its own, and only those counts (one per
    partition) are gathered.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = pinned(
        totals.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .select(
            "source",
            "source_size",
            F.spark_partition_id().alias("part"),
            (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("place"),
        ),
        "sources",
    )
    counts = placed.groupBy("part").count().orderBy("part").collect()
    starts, seen = [], 0
    for row in counts:
        starts.append((row["part"], seen))
        seen += row["count"]
    first = placed.sparkSession.createDataFrame(starts, "part int, start long")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    return placed.join(F.broadcast(first), "part").select(
        "source",
        "source_size",
        F.get(cycle, ((F.col("start") + F.col("place")) % len(weights)).cast("int")).alias("weight"),
    )


def targets(sources: DataFrame, ceiling: int = 3) -> DataFrame:
    """(source, source_size, weight, target): all words shared by weight, none above ``ceiling`` times its size.

    What is above goes to the others by weight, again and again; every round is one aggregate over the sources.
    Sums are exact decimals, so that reruns and other engines agree.
    """
    wide = T.DecimalType(38, 0)
    size, weight = F.col("source_size").cast(T.DecimalType(19, 0)), F.col("weight").cast(T.DecimalType(10, 0))
    most = size * F.lit(ceiling)
    total = sources.agg(F.sum(size)).first()[0] or Decimal(0)
    share, among = total, None
    full = F.lit(False)
    while True:
        row = sources.where(~full).agg(F.sum(weight).alias("w"), F.count("*").alias("n")).first()
        held = sources.where(full).agg(F.sum(most).alias("m"), F.count("*").alias("n")).first()
        share, among = total - (held["m"] or 0), row["w"]
        if not row["n"] or not total:
            break
        above = (weight * F.lit(share).cast(T.DecimalType(27, 0))).cast(wide) > (most * F.lit(among).cast(T.DecimalType(16, 0))).cast(wide)
        more = sources.where(~full & above).limit(1).count()
        if not more:
            break
        full = above
    even = F.col("weight") * F.lit(float(share)) / F.lit(float(among or 1))
    return sources.withColumn("target", F.when(full, (F.col("source_size") * ceiling).cast("double")).otherwise(even))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), ceiling: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source, source_size, target, rate, copies, taken) of each row of ``docs``.

    A document is taken floor(rate) times and once more if its seeded draw is below the fraction. Null texts have
    no words, null sources form one source (the last), a source without words has rate 0, repeated rows get the
    same draw, an empty table gives no rows. A null id draws as the text ``null``.
    """
    sized = pinned(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    # the number of rounds of resharing is unknown, so the numbered sources are read from a pinned table
    shared = targets(pinned(numbered_sources(sized, weights), "weights"), ceiling)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    theirs = small_side(shared.select(F.col("source").alias("of_source"), "source_size", "target", rate.alias("rate")))
    whole = F.floor("rate")
    extra = (seeded_draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return (
        sized.join(theirs, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("copies", whole + extra)
        .select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed_rows(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), ceiling: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (columns of ``docs`` alone)."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    shared = targets(pinned(numbered_sources(sized, weights), "weights"), ceiling)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    theirs = small_side(shared.select(F.col("source").alias("of_source"), rate.alias("of_rate")))
    row = docs.select(F.struct("*").alias("row"))
    whole = F.floor("of_rate")
    extra = (seeded_draw(F.col("row.doc_id"), seed) < F.col("of_rate") - whole).cast("long")
    return (
        row.join(theirs, F.col("row.source").eqNullSafe(F.col("of_source")))
        .withColumn("copies", (whole + extra).cast("int"))
        .where("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("row.*")
    )


#: DuckDB's rows of the mix over a relation ``{docs}``; weights 1, 2, 3, ceiling 3.
MIX_SQL = r"""
sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM {docs}),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight
  FROM sized GROUP BY source),
run AS (
  SELECT *, row_number() OVER w AS k,
         CAST(sum(source_size) OVER () AS HUGEINT) - 3 * CAST(sum(source_size) OVER w - source_size AS HUGEINT) AS share,
         CAST(sum(weight) OVER () AS HUGEINT) - CAST(sum(weight) OVER w - weight AS HUGEINT) AS among
  FROM src WINDOW w AS (ORDER BY source_size * (6 // weight), source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lvl AS (SELECT k, share, among FROM run WHERE weight * share <= 3 * source_size * among ORDER BY k LIMIT 1),
tgt AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.k < l.k THEN CAST(3 * r.source_size AS DOUBLE)
              ELSE CAST(r.weight AS DOUBLE) * CAST(l.share AS DOUBLE) / CAST(l.among AS DOUBLE) END AS target
  FROM run r CROSS JOIN lvl l),
mixed AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT doc_id, size, source, source_size, target,
         CAST(floor(rate) AS BIGINT) + CAST(draw < rate - floor(rate) AS BIGINT) AS copies
  FROM mixed)
"""
