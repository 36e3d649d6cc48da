"""Workspace-shaped inputs derived from the star-schema tables (mail, tasks, events, grids, elements)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from officelake.functions.strings import utf16_len

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_EPOCH_2024 = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, spread over the cores when its files give too few tasks for parsing it.

    Counting the tasks of a plain scan costs planning only; a table of many files is left as it is.
    """
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages: one per conversation turn."""
    return as_mail(table(spark, sf_dir, "conversations"))


def as_mail(c: DataFrame) -> DataFrame:
    """Conversation turns as messages."""
    minutes = F.col("conv_id") * 60 + F.col("turn")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("conv_id").cast("string").alias("thread_id"),
        F.col("turn"),
        F.col("role"),
        F.concat("role", F.lit("@example.com")).alias("senders"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.date_format(F.timestamp_seconds(F.lit(_EPOCH_2024) + minutes * 60), ISO_Z).alias("received_date"),
        F.col("text").alias("body"),
    )


MAIL_SQL = """mail AS (
  SELECT conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS thread_id, turn, role,
         role || '@example.com' AS senders, split_part(text, chr(10), 1) AS subject,
         strftime(TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn), '%Y-%m-%dT%H:%M:%SZ') AS received_date,
         text AS body
  FROM conversations)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar entries: start = ts, end = ts + value minutes."""
    e = table(spark, sf_dir, "events")
    start_us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("summary"),
        F.col("props").alias("description"),
        F.concat(F.lit("room "), F.col("user_id").cast("string")).alias("location"),
        start_us.alias("start_us"),
        (start_us + F.round(F.col("value") * 60000000).cast("long")).alias("end_us"),
        F.array(
            F.concat(F.col("user_id").cast("string"), F.lit("@example.com")),
            F.concat("event_type", F.lit("@example.com")),
        ).alias("attendees"),
    )


CALENDAR_SQL = """calendar AS (
  SELECT event_id AS id, event_type AS summary, props AS description, 'room ' || user_id AS location,
         epoch_us(ts) AS start_us,
         epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS end_us,
         [user_id || '@example.com', event_type || '@example.com'] AS attendees
  FROM events)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks: one per order, in the list of its customer; finished orders carry an external link line."""
    o = table(spark, sf_dir, "orders")
    link = F.concat(F.lit("\U0001f517 http://t/"), F.col("o_orderkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("tasklist_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("needsAction").alias("status"),
        F.when(F.col("o_orderstatus") != "O", F.concat(link, F.lit("\n"), F.col("o_orderpriority")))
        .otherwise(F.col("o_orderpriority"))
        .alias("notes"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("due"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(True)).alias("deleted"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit(True)).alias("hidden"),
        F.col("o_totalprice").alias("position"),
    )


TASKS_SQL = """tasks AS (
  SELECT o_orderkey AS id, o_custkey AS tasklist_id, 'Order ' || o_orderkey AS title,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'needsAction' END AS status,
         CASE WHEN o_orderstatus <> 'O' THEN chr(128279) || ' http://t/' || o_orderkey || chr(10) || o_orderpriority
              ELSE o_orderpriority END AS notes,
         strftime(o_orderdate, '%Y-%m-%d') AS due,
         CASE WHEN o_orderpriority = '5-LOW' THEN true END AS deleted,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN true END AS hidden,
         o_totalprice AS position
  FROM orders)"""

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def action_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action items: one per order line, numbered within the order."""
    from officelake.operators.ordering import ordinal

    rows = ordinal(
        table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col(c) for c in LINE_ORDER], "action_number", bounded=True
    )
    return rows.select(
        F.col("l_orderkey").alias("analysis_id"),
        "action_number",
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))).alias(
            "notes"
        ),
        F.when(F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "A", "Critical").otherwise("high"))
        .when(F.col("l_returnflag") == "R", "medium")
        .when(F.col("l_returnflag") == "A", "low")
        .alias("priority"),
        F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("due_date"),
        F.when(
            F.col("l_linenumber") == 1,
            F.array(
                F.struct(
                    F.lit(None).cast("string").alias("title"),
                    F.concat(F.lit("http://parts/no "), F.col("l_partkey").cast("string")).alias("url"),
                ),
                F.struct(
                    F.lit("supplier").alias("title"),
                    F.concat(F.lit("http://suppliers/"), F.col("l_suppkey").cast("string")).alias("url"),
                ),
            ),
        ).alias("links"),
        "l_returnflag",
        "l_linestatus",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


ITEMS_SQL = """items AS (
  SELECT l_orderkey AS analysis_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                            l_extendedprice, l_shipdate) - 1 AS action_number,
         'Part ' || l_partkey AS title,
         CASE WHEN l_returnflag <> 'N' THEN 'Supplier ' || l_suppkey END AS notes,
         CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'A' THEN 'Critical' ELSE 'high' END
              WHEN l_returnflag = 'R' THEN 'medium' WHEN l_returnflag = 'A' THEN 'low' END AS priority,
         CASE WHEN l_linestatus = 'O' THEN strftime(l_shipdate, '%Y-%m-%d') END AS due_date,
         l_returnflag, l_linestatus, l_linenumber, l_partkey, l_suppkey
  FROM lineitem)"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing results: a category for the documents that have a label."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, "other").when(F.col("quality") == 1, "useful").otherwise("unknown").alias(
            "category"
        ),
    )


CATEGORIES_SQL = """categories AS (
  SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'other' WHEN quality = 1 THEN 'useful' ELSE 'unknown' END AS category
  FROM labels)"""

# Heading styles in rank order.
STYLES = ["TITLE", "HEADING_1", "HEADING_2", "HEADING_3", "HEADING_4", "HEADING_5", "HEADING_6"]


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural elements: one per line of a document; short lines act as headings of varying rank.

    A document arrives as one row, so the elements of one document are bounded by what a row can hold.
    """
    from pyspark.sql import Window as W

    # Shuffled by document before the lines are exploded, so that windows per document need no further shuffle.
    d = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    d = d.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    size = utf16_len(F.col("line")) + 1
    upto = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    style = F.element_at(F.array(*[F.lit(s) for s in STYLES]), (F.length("line") % 7 + 1).cast("int"))
    is_heading = F.length("line") <= 80
    return (
        d.withColumn("_size", size)
        .withColumn("end_index", F.sum("_size").over(upto) + 1)
        .select(
            "doc_id",
            "pos",
            (F.col("end_index") - F.col("_size")).alias("start_index"),
            "end_index",
            F.when(is_heading, style).otherwise("NORMAL_TEXT").alias("level"),
            F.when(is_heading, F.concat_ws(".", F.lit("h"), "doc_id", "pos")).alias("heading_id"),
            F.concat("line", F.lit("\n")).alias("text"),
        )
    )


ELEMENTS_SQL = r"""lines AS (
  SELECT doc_id, i AS pos, string_split(text, chr(10))[i + 1] AS line
  FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
sized AS (
  SELECT *, length(line) + length(regexp_replace(line, '[^\x{10000}-\x{10FFFF}]', '', 'g')) + 1 AS size FROM lines),
elements AS (
  SELECT doc_id, pos,
         CAST(1 + sum(size) OVER w - size AS BIGINT) AS start_index, CAST(1 + sum(size) OVER w AS BIGINT) AS end_index,
         CASE WHEN length(line) <= 80 THEN
           ['TITLE','HEADING_1','HEADING_2','HEADING_3','HEADING_4','HEADING_5','HEADING_6'][length(line) % 7 + 1]
           ELSE 'NORMAL_TEXT' END AS level,
         CASE WHEN length(line) <= 80 THEN 'h.' || doc_id || '.' || pos END AS heading_id,
         line || chr(10) AS text
  FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
