"""Task and task-list scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from officelake.functions.strings import get_id_url


def generate_lists(lists: DataFrame) -> DataFrame:
    """Every task list."""
    return lists.select("id", "title")


def generate_tasks(
    tasks: DataFrame,
    lists: DataFrame,
    tasklist_id: int | str | None = None,
    show_completed: bool = False,
    show_deleted: bool = False,
    show_hidden: bool = False,
) -> DataFrame:
    """Tasks of one list, or of all lists; completed, deleted and hidden ones only when asked for."""
    out = tasks
    if tasklist_id is not None:
        out = out.where(F.col("tasklist_id") == tasklist_id)
    if not show_completed:
        out = out.where(~F.col("status").eqNullSafe("completed"))
    if not show_deleted:
        out = out.where(~F.coalesce("deleted", F.lit(False)))
    if not show_hidden:
        out = out.where(~F.coalesce("hidden", F.lit(False)))
    return out.join(lists.select(F.col("id").alias("tasklist_id")), "tasklist_id", "left_semi")


def get_tasks(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Point lookups by (tasklist_id, id); a missing task is an error row."""
    found = tasks.withColumn("_found", F.lit(True))
    joined = requests.join(found, ["tasklist_id", "id"], "left")
    return joined.withColumn(
        "error",
        F.when(
            F.col("_found").isNull(),
            F.concat(F.lit("task not found: "), F.col("tasklist_id").cast("string"), F.lit("/"), F.col("id").cast("string")),
        ),
    ).drop("_found")


def managed_tasks(tasks: DataFrame, include_plain: bool = False) -> DataFrame:
    """Tasks with an external URL in their notes (as ``id_url``), optionally also the plain ones."""
    out = tasks.withColumn("id_url", get_id_url(F.col("notes")))
    return out if include_plain else out.where(F.col("id_url").isNotNull())


def parse_task_batch(batches: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """Tasks of JSON array texts, one row each; a text that is no such array becomes an error row."""
    parsed = F.from_json(F.col(text), T.ArrayType(schema), {"mode": "PERMISSIVE"})
    is_array: Column = F.col(text).rlike(r"(?s)^\s*\[.*\]\s*$")
    rest = [c for c in batches.columns if c != text]
    tagged = batches.select(*rest, F.when(is_array, parsed).alias("_tasks"))
    return tagged.select(
        *rest,
        F.explode_outer("_tasks").alias("task"),
        F.when(F.col("_tasks").isNull(), F.lit("expected a JSON array of tasks")).alias("error"),
    )
