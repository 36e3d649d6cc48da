"""Polled jobs as Structured Streaming queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

from officelake.operators.filters import unprocessed
from officelake.operators.ordering import global_index, last_wins
from officelake.session import work_dir
from officelake.sinks.merge import add_in, upsert_in
from officelake.sinks.store import Placed, TableStore, bucket_of

POLL_SECONDS = 60  # fixed value: pause between two runs
ATTEMPTS = "_attempts"


class FailedItems(RuntimeError):
    """Items failed and the job was asked to be strict."""


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_run: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_run:
        reader = reader.option("maxFilesPerTrigger", files_per_run)
    return reader.parquet(path)


@dataclass
class PolledJob:
    """Runs ``process`` on the items of a stream that have no result yet.

    ``process`` takes the new items and returns rows with ``value`` (a struct of the result) and ``error``.
    Every run re-reads which keys are done, so a run repeated after a failure does nothing twice. Items beyond
    ``limit`` and items that failed stay in a table of pending ones and are taken up by the next run, those that failed
    less often first, so that failing items never keep others waiting. Results, failures and pending items of one run
    are published together; with ``save_every`` results are published before that, so many items at a time, however the
    stream's files are cut, and a run that breaks off keeps what has been saved.
    """

    store: TableStore
    results: str
    key: str
    order: list[Column]
    process: Callable[[DataFrame], DataFrame]
    strict: bool = False
    force_all: bool = False
    limit: int | None = None
    save_every: int | None = None
    failures: str = "failures"
    pending: str = "pending"
    failed: list[str] = field(default_factory=list)
    ran: int = 0
    saves: int = 0

    def run_once(self, items: DataFrame) -> None:
        """One run over a batch of items and all pending ones."""
        self.ran += 1
        since = self.store.begin().number
        waiting = self.store.read(self.pending) if self.store.exists(self.pending) else None
        if waiting is not None:
            items = items.unionByName(waiting.select(items.columns))
        latest = last_wins(items, [self.key], self.order)
        if self.store.exists(self.results):
            done = self.store.read(self.results, self.store.buckets_of(self.results, latest))
            latest = unprocessed(latest, done, self.key, self.force_all)
        if waiting is not None:
            latest = latest.join(waiting.select(self.key, ATTEMPTS), self.key, "left")
        else:
            latest = latest.withColumn(ATTEMPTS, F.lit(None).cast("int"))
        # pinned: what is left over must be the complement of what was taken
        latest = pinned(latest.withColumn(ATTEMPTS, F.coalesce(ATTEMPTS, F.lit(0))))
        taken = latest if self.limit is None else latest.orderBy(ATTEMPTS, self.key).limit(self.limit)
        taken = taken.drop(ATTEMPTS)
        outcome = self._answered(taken) if self.save_every is None else self._saved_in_parts(taken, since)
        txn = self.store.begin()
        good = outcome.where(F.col("error").isNull()).select(self.key, "value.*")
        if self.save_every is None:
            upsert_in(txn, self.store, self.results, good, [self.key])
        bad = outcome.where(F.col("error").isNotNull()).select(self.key, "error")
        txn.replace(self.failures, bad)
        left = latest.join(good.select(self.key), self.key, "left_anti")
        missed = bad.select(self.key, F.lit(1).alias("_missed")).distinct()
        left = left.join(missed, self.key, "left").withColumn(ATTEMPTS, F.col(ATTEMPTS) + F.coalesce("_missed", F.lit(0)))
        txn.replace(self.pending, left.drop("_missed"))
        txn.commit()
        first = bad.first()
        self.failed = [] if first is None else [first["error"]]

    def _answered(self, taken: DataFrame) -> DataFrame:
        """What ``process`` makes of the items, written once: a model behind it is not asked again by later reads."""
        return pinned(self.process(taken))

    def _saved_in_parts(self, taken: DataFrame, since: int) -> DataFrame:
        """The same, with the results of every ``save_every`` items published before the next ones are begun.

        Items are taken bucket by bucket of the results, and each part is a folder of its own, so that a save reads and
        writes a bucket or two, however many items there are. Answers are written once, into the store by bucket, and a
        save takes their folders over as they are: items have no result yet, so it is enough that a part answers no key
        twice and none but its own items'. Where it does, or results were published by others since commit ``since``, or
        ``force_all`` takes items that have results, the answers are compared with what is stored, there and in the parts
        that follow. The answers of all parts are read back at once.
        """
        spark, store, name = self.store.spark, self.store, self.results
        root, folder = work_dir(spark, "parts"), store.new_folder(name)
        key, n = [self.key], store.buckets(name)
        bucket = bucket_of(key, n)
        numbered = global_index(taken, [bucket, F.col(self.key)], "_place")
        numbered = numbered.select((F.col("_place") / self.save_every).cast("long").alias("_part"), *taken.columns)
        numbered.write.partitionBy("_part").parquet(f"{root}/items")
        sums = [F.count("*"), *[F.sum(F.xxhash64(F.lit(i), self.key).cast("decimal(20,0)")) for i in (0, 1)]]
        sums = [c.alias(f"_{i}") for i, c in enumerate(sums)]  # of keys: equal ones mean the same keys, as often
        held = spark.read.schema(taken.schema).parquet(f"{root}/items").groupBy("_part").agg(*sums)
        held = {r["_part"]: r.asDict() for r in held.collect()}  # a row per part
        error = F.col("error").alias("_error")
        marked = ["*", F.col("_error").isNotNull().alias("_bad"), bucket.alias("_bucket")]
        apart = not self.force_all or not store.exists(name)  # so far, no item has a result
        for number in range(0, max(1, len(held))):
            # without items there is one save, of nothing
            items = spark.read.schema(taken.schema).parquet(f"{root}/items/_part={number}") if held else taken
            flat, seen = self.process(items).select(self.key, "value.*", error), Observation()
            part = f"{folder}/_part={number}"
            flat.observe(seen, *sums).select(*marked).write.partitionBy("_bad", "_bucket").parquet(f"{store.root}/{part}")
            good = Placed(T.StructType(flat.schema.fields[:-1]), key, n, store.bucket_dirs(f"{part}/_bad=false"))
            txn = store.begin()
            apart = apart and txn.number == since
            own = not good.dirs or {"_part": number, **seen.get} == held.get(number)
            apart = apart and (own or self._own_keys(items, store.rows(good)))
            add_in(txn, store, name, good if apart else store.rows(good), key)
            txn.commit()
            since = txn.number + 1
            self.saves += 1
        answers = spark.read.schema(flat.schema).parquet(f"{store.root}/{folder}")
        return answers.select(self.key, F.struct(*good.schema.names[1:]).alias("value"), F.col("_error").alias("error"))

    def _own_keys(self, items: DataFrame, answers: DataFrame) -> bool:
        """Whether the answers have no key twice and none but those of the items; both are one part, read by one task."""
        if items.schema[self.key].dataType != answers.schema[self.key].dataType:
            return False
        both = items.select(self.key, F.lit(0).alias("_answer")).union(answers.select(self.key, F.lit(1)))
        counted = both.coalesce(1).groupBy(self.key).agg(F.count("*").alias("_rows"), F.sum("_answer").alias("_answers"))
        return counted.where((F.col("_answers") > 1) | (F.col("_rows") == F.col("_answers"))).isEmpty()

    def start(self, stream: DataFrame, checkpoint: str, interval: float = 0):
        """Start the query: once over what is there (0), or again every ``interval`` seconds."""
        writer = stream.writeStream.foreachBatch(lambda df, _: self.run_once(df))
        writer = writer.option("checkpointLocation", checkpoint)
        trigger = {"processingTime": f"{interval} seconds"} if interval > 0 else {"availableNow": True}
        return writer.trigger(**trigger).start()

    def finish(self, query, schema: T.StructType | None = None) -> None:
        """Wait for a run-once query; with ``strict`` items that failed in its last run make it fail at the end.

        With the items' ``schema``, a poll that saw nothing new still takes up pending items.
        """
        before = self.ran
        query.awaitTermination()
        if schema is not None and self.ran == before and self.store.exists(self.pending):
            self.run_once(self.store.spark.createDataFrame([], schema))
        if self.strict and self.failed:
            raise FailedItems(self.failed[0])


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = work_dir(df.sparkSession, "items")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deduplicated(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each key once. Without an event time the keys are remembered for ever, with one for the delay."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def with_feed(df: DataFrame, name: str, key: str, failed: Column, sample: Column) -> DataFrame:
    """Count, failures and a sample of what passes, as metrics of each batch (no second pass over the data)."""
    return df.observe(
        name,
        F.count(F.lit(1)).alias("items"),
        F.count_if(failed).alias("errors"),
        F.max(F.struct(F.col(key), sample.alias("sample"))).alias("last"),
    )


class Feeds(StreamingQueryListener):
    """Keeps one metric of every batch of the streams started while it listens, however many there are."""

    def __init__(self, name: str):
        self.name, self.rows = name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None and found["items"]:
            self.rows.append(found)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def collected(self, spark: SparkSession, query) -> list:
        """The metrics of a query, once it has ended and its last report has come in."""
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(self)
        return self.rows


def append_log(stream: DataFrame, store: TableStore, table: str, order: list[Column], checkpoint: str):
    """Publish a stream of messages to a log with rising ids, each batch exactly once.

    The table ``<table>_head`` has one row, the last batch and its highest id, published with the batch's rows: so a
    batch repeated after a failure is recognised, and no batch reads the log.
    """
    from officelake.operators.bus import publish

    head = f"{table}_head"

    def put(batch: DataFrame, number: int) -> None:
        last, high = store.read(head).first() if store.exists(head) else (-1, 0)
        if number <= last:
            return
        rows = publish(None, batch, order).withColumn("id", F.col("id") + high).withColumn("batch", F.lit(number).cast("long"))
        newest = rows.agg(F.max("id")).first()[0] or high  # the numbered rows are checkpointed
        txn = store.begin()
        txn.append(table, rows)
        txn.replace(head, store.spark.createDataFrame([(number, newest)], "batch long, id long"))
        txn.commit()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
