"""Task sync with change detection: rows plus the action each needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from officelake.functions.strings import set_id_url
from officelake.operators.lookups import first_match
from officelake.sources.tasks import managed_tasks

SERVER_FIELDS = ["etag", "updated", "selfLink", "position"]  # fixed value: ignored when comparing
NOT_PATCHED = ["id", *SERVER_FIELDS, "id_url", "tasklist_id"]  # fixed value: never patched
DEFAULT_LIST = "@default"  # fixed value: list of tasks that name none


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def upsert_tasks(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``action`` create, update, noop or error per incoming task, compared without the server's fields."""
    rest = [c for c in incoming.columns if c != "id"]
    old = stored.select("id", F.struct(*[c for c in stored.columns if c != "id"]).alias("_old"))
    joined = incoming.join(old, "id", "left")
    compared = [c for c in rest if c not in SERVER_FIELDS and c in stored.columns]
    changed = _any([~F.col(c).eqNullSafe(F.col("_old")[c]) for c in compared])
    action = (
        F.when(F.col("id").isNull(), "create")
        .when(F.col("_old").isNull(), "error")
        .when(changed, "update")
        .otherwise("noop")
    )
    return joined.select("id", *rest, action.alias("action"))


def _is_set(c: Column, kind: T.DataType) -> Column:
    """Whether a patch field carries a value; an empty list does not."""
    return (c.isNotNull() & (F.size(c) > 0)) if isinstance(kind, T.ArrayType) else c.isNotNull()


def upsert_managed(
    incoming: DataFrame, stored: DataFrame, order: list[Column], default_list: Column | None = None
) -> DataFrame:
    """Sync tasks keyed by external URL: patch set fields, move between lists, create new ones.

    ``actions`` lists what has to be done, in order: create, move, update, noop, or error without a URL.
    """
    default = F.lit(DEFAULT_LIST) if default_list is None else default_list
    # The first stored task with the URL counts, in scan order of lists and tasks.
    existing = first_match(managed_tasks(stored), "id_url", order)
    fields = [f for f in incoming.schema.fields if f.name not in NOT_PATCHED and f.name in stored.columns]
    old = existing.select("id_url", F.struct(*[c for c in existing.columns if c != "id_url"]).alias("_old"))
    src = incoming.withColumn("notes", set_id_url(F.col("notes"), F.col("id_url")))
    j = src.join(old, "id_url", "left")
    found = F.col("_old").isNotNull()
    move = found & F.col("tasklist_id").isNotNull() & (F.col("tasklist_id") != F.col("_old.tasklist_id"))

    def stored_value(name: str) -> Column:
        value = F.col("_old")[name]
        return set_id_url(value, F.col("id_url")) if name == "notes" else value

    dirty = _any([_is_set(F.col(f.name), f.dataType) & ~F.col(f.name).eqNullSafe(stored_value(f.name)) for f in fields])
    step = lambda cond, name: F.when(cond, F.lit(name))
    todo = F.array_compact(F.array(step(move, "move"), step(dirty, "update")))
    actions = (
        F.when(F.coalesce(F.col("id_url"), F.lit("")) == "", F.array(F.lit("error")))
        .when(~found, F.array(F.lit("create")))
        .when(F.size(todo) > 0, todo)
        .otherwise(F.array(F.lit("noop")))
    )
    patched = [
        F.when(_is_set(F.col(f.name), f.dataType), F.col(f.name)).otherwise(stored_value(f.name)).alias(f.name)
        for f in fields
    ]
    place = F.when(found, F.coalesce("tasklist_id", "_old.tasklist_id")).otherwise(F.coalesce("tasklist_id", default))
    return j.select(
        "id_url", F.col("_old.id").alias("id"), place.alias("tasklist_id"), *patched, actions.alias("actions")
    )


def event_changes(events: DataFrame, stored: DataFrame) -> DataFrame:
    """What to send for calendar events: (id, action, body), the body without what an event does not set.

    An event without an id is created, one whose id is stored is updated, any other id is an error.
    """
    from officelake.operators.filters import payload

    asked = events.select("id", payload(events).alias("body"))
    known = stored.select("id", F.lit(True).alias("_known")).distinct()
    action = F.when(F.col("id").isNull(), "create").when(F.col("_known"), "update").otherwise("error")
    return asked.join(known, "id", "left").select("id", action.alias("action"), "body")
