"""Result cache as a table of calls keyed by ``(reg_key, args_hash)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from officelake.functions.dates import still_valid
from officelake.functions.jsons import call_text, json_quote
from officelake.inference.model import ModelSpec, generate_text
from officelake.operators.ordering import last_wins
from officelake.sinks.store import TableStore

KEY = ["reg_key", "args_hash"]
DEFAULT_AGE_SECONDS = 30 * 24 * 3600  # fixed value: 30 days since the last access


def prompt_call(prompt: Column) -> Column:
    """Canonical text of a model call with one prompt part."""
    none = F.lit("null")
    return call_text([json_quote(prompt)], {"output_format": none, "schema": none})


def get(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """Look up keys; a miss has a null value."""
    return keys.join(calls.select(*KEY, "value"), KEY, "left")


def add(calls: DataFrame, new: DataFrame) -> DataFrame:
    """Add calls; a call with a key that is there replaces it."""
    latest = last_wins(new, KEY, [F.col("added"), F.col("value")])
    return calls.join(latest.select(*KEY), KEY, "left_anti").unionByName(latest)


def remove(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop calls by key."""
    return calls.join(keys.select(*KEY), KEY, "left_anti")


def touch(calls: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Refresh the access time of the calls that were hit."""
    mark = hits.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    out = calls.join(mark, KEY, "left")
    return out.withColumn("accessed", F.when(F.col("_hit"), now).otherwise(F.col("accessed"))).drop("_hit")


#: Folders a bucket of the cache may have before it is written anew.
CROWDED = 8


def compacted(store: TableStore, table: str, buckets: list[int] | None, most: int = CROWDED) -> None:
    """Write those of the buckets anew, as one folder each, that calls have been added to more than ``most`` times.

    So a lookup opens a bounded number of folders however long the cache has been in use, and a call that was added
    is rewritten once in so many calls.
    """
    folders = store._latest()[1][table]["dirs"]
    crowded = [int(b) for b, held in folders.items() if len(held) > most and (buckets is None or int(b) in set(buckets))]
    if crowded:
        txn = store.begin()
        txn.replace_buckets(table, store.read(table, crowded), crowded)
        txn.commit()


def cached_call(
    store: TableStore,
    table: str,
    df: DataFrame,
    prompt: Column,
    model: ModelSpec,
    now: Column,
    touch_on_hit: bool = False,
) -> DataFrame:
    """Answers from the cache, calling the model once per distinct missing prompt.

    The new calls are published before they are read back, so a lost executor repeats no call that has
    finished. Failed calls are not stored; their rows have no value.
    """
    key = F.lit(model.cache_key)
    keyed = df.withColumn("_prompt", model.preprocess(prompt))
    keyed = keyed.withColumn("_call", prompt_call(F.col("_prompt"))).withColumns(
        {"reg_key": key, "args_hash": F.md5("_call")}
    )
    misses = keyed.select(*KEY, "_call", "_prompt").dropDuplicates(KEY)
    touched = None
    if store.exists(table):
        # only the buckets these calls fall into are read or rewritten
        touched = store.buckets_of(table, keyed)
        compacted(store, table, touched)
        stored = store.read(table, touched)
        if touch_on_hit:
            txn = store.begin()
            txn.replace_buckets(table, touch(stored, keyed, now), touched)
            txn.commit()
            stored = store.read(table, touched)
        misses = misses.join(stored.select(*KEY), KEY, "left_anti")
    asked = misses.withColumn("_answer", generate_text(F.col("_prompt"), model))
    calls = asked.where(F.col("_answer.value").isNotNull()).select(
        *KEY,
        F.col("_call").alias("serialized_args"),
        F.col("_answer.value").alias("value"),
        now.alias("added"),
        now.alias("accessed"),
    )
    if store.exists(table):
        store.append(table, calls)
    else:
        store.replace(table, calls, KEY)
    return get(store.read(table, touched), keyed.drop("_prompt", "_call"))


def with_prefix(calls: DataFrame, prefix: str) -> DataFrame:
    """Calls as written through a prefix view."""
    return calls.withColumn("reg_key", F.concat(F.lit(prefix), "reg_key"))


def prefix_view(calls: DataFrame, prefix: str) -> DataFrame:
    """Calls seen through a prefix view."""
    mine = calls.where(F.col("reg_key").startswith(prefix))
    return mine.withColumn("reg_key", F.expr(f"substring(reg_key, {len(prefix) + 1})"))


def purge(
    calls: DataFrame,
    reference: Column,
    default_access: float | None = DEFAULT_AGE_SECONDS,
    default_added: float | None = None,
    prefix_ages: list[tuple[str, float | None, float | None]] = [],
) -> DataFrame:
    """Drop calls accessed or added too long ago.

    ``prefix_ages`` lists (prefix, max access age, max added age); of the prefixes a key starts with the
    first counts, and its ages override the defaults one by one. The rules are settings, so they become
    one ``CASE`` and no join.
    """

    def age(position: int, default: float | None) -> Column:
        fallback = F.lit(default).cast("double")
        out = F.when(F.lit(False), fallback)
        for rule in prefix_ages:
            out = out.when(F.col("reg_key").startswith(rule[0]), F.coalesce(F.lit(rule[position]).cast("double"), fallback))
        return out.otherwise(fallback)

    return calls.where(
        still_valid(F.col("accessed"), reference, age(1, default_access))
        & still_valid(F.col("added"), reference, age(2, default_added))
    )


def stats(calls: DataFrame) -> DataFrame:
    """Per key the number of calls and the first and last access."""
    return calls.groupBy("reg_key").agg(
        F.count("*").alias("calls"), F.min("accessed").alias("first_accessed"), F.max("accessed").alias("last_accessed")
    )


def load(store: TableStore, table: str, reference: Column, empty: DataFrame, **ages) -> DataFrame:
    """Stored calls without the expired ones; no table is an empty cache."""
    return purge(store.read(table), reference, **ages) if store.exists(table) else empty


def save(store: TableStore, table: str, calls: DataFrame, reference: Column, **ages) -> None:
    """Store calls without the expired ones."""
    store.replace(table, purge(calls, reference, **ages), KEY)
