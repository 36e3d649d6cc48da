"""Topic log: publishing, retention, peeking and per-agent offsets.

A few topics may carry all messages, so no topic is ever one window: retention cuts topics in slices first, and
the search for the next message works in blocks of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from officelake.operators.ordering import global_index, newest

MAX_MESSAGES = 100  # fixed value: messages kept per topic
BLOCK = 65_536


def publish(log: DataFrame | None, messages: DataFrame, order: list[Column]) -> DataFrame:
    """New log rows with ids that go on after the log's highest one."""
    high = 0 if log is None else (log.agg(F.max("id")).first()[0] or 0)
    return global_index(messages, order, "_i").withColumn("id", F.col("_i") + high + 1).drop("_i")


def retained(log: DataFrame, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """The newest messages of every topic; 0 or less keeps all."""
    return log if max_messages <= 0 else newest(log, ["topic"], [F.col("id").desc()], max_messages)


def peek(log: DataFrame, limit: int, topic: str | None = None) -> DataFrame:
    """The newest ``limit`` messages per topic (or of one), read in ascending order; none for 0."""
    rows = log if topic is None else log.where(F.col("topic") == topic)
    return rows.where(F.lit(False)) if limit <= 0 else newest(rows, ["topic"], [F.col("id").desc()], limit)


def next_ids(log: DataFrame, subscriptions: DataFrame, cursors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per (agent, topic) subscription the smallest message id after the agent's offset.

    An agent without a cursor starts at 0. Messages and offsets are sorted together in blocks of ids; where
    the block of an offset has no later message, the first one of a later block counts.
    """
    wanted = subscriptions.join(cursors, ["agent", "topic"], "left").select(
        "agent", "topic", F.coalesce("offset", F.lit(0)).cast("long").alias("offset")
    )
    # Many agents stand at the same offset, most of all at 0; each offset is looked up once.
    offsets = wanted.select("topic", F.col("offset").alias("id"), F.lit(0).alias("kind")).distinct()
    points = offsets.unionByName(log.select("topic", "id", F.lit(1).alias("kind")))
    points = points.withColumn("_block", F.expr(f"id div {int(block)}"))
    message = F.when(F.col("kind") == 1, F.col("id"))
    firsts = points.groupBy("topic", "_block").agg(F.min(message).alias("_first"))
    later = W.partitionBy("topic").orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    firsts = firsts.select("topic", "_block", F.last("_first", ignorenulls=True).over(later).alias("_later"))
    # From the highest id down, an offset before a message of the same id: what was seen last comes next.
    after = W.partitionBy("topic", "_block").orderBy(F.col("id").desc(), "kind").rowsBetween(W.unboundedPreceding, -1)
    seen = points.withColumn("_here", F.last(message, ignorenulls=True).over(after)).where(F.col("kind") == 0)
    out = seen.join(firsts, ["topic", "_block"])
    found = out.select("topic", F.col("id").alias("offset"), F.coalesce("_here", "_later").alias("next_id"))
    return wanted.join(found, ["topic", "offset"]).select("agent", "topic", "offset", "next_id")


def next_messages(log: DataFrame, subscriptions: DataFrame, cursors: DataFrame) -> DataFrame:
    """The next message per agent over all its topics."""
    ids = next_ids(log, subscriptions, cursors).where(F.col("next_id").isNotNull())
    first = ids.groupBy("agent").agg(F.min("next_id").alias("id"))
    return first.join(log, "id")


def receive(log: DataFrame, subscriptions: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next message per agent, and the cursors after it has been taken."""
    got = next_messages(log, subscriptions, cursors)
    moved = got.select("agent", "topic", F.col("id").alias("_id"))
    out = cursors.join(moved, ["agent", "topic"], "full_outer")
    return got, out.select("agent", "topic", F.coalesce("_id", "offset").alias("offset"))


def agents(log: DataFrame, seen: DataFrame) -> DataFrame:
    """Agents with the time they were last seen; one that gave no name gets one."""
    both = log.select(F.col("sender").alias("agent"), "ts").unionByName(
        seen.select(F.coalesce("agent", F.uuid()).alias("agent"), "ts")
    )
    return both.groupBy("agent").agg(F.max("ts").alias("last_seen"))


def topics(log: DataFrame) -> DataFrame:
    """Topics that have messages."""
    return log.select("topic").distinct()
