"""Predicates and projections over item tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

NOT_PLACED = "(None)"  # fixed value: placement id of an item whose position is not known again


def unprocessed(items: DataFrame, done: DataFrame, key: str = "id", force_all: bool = False) -> DataFrame:
    """Items whose key is not among the processed ones; ``force_all`` leaves the join out of the plan."""
    if force_all:
        return items
    return items.join(done.select(key), key, "left_anti")


def unplaced(
    items: DataFrame, placements: DataFrame, container_url: str, force_all: bool = False
) -> DataFrame:
    """Action items not yet placed in this container; items without an analysis id are dropped."""
    items = items.where(F.col("analysis_id").isNotNull())
    if force_all:
        return items
    placed = placements.where(
        (F.col("placement_container_url") == container_url) & (F.col("placement_id") == NOT_PLACED)
    ).select("analysis_id", "action_number")
    return items.join(placed, ["analysis_id", "action_number"], "left_anti")


def matches_priority(pattern: str = ".*", column: str = "priority") -> Column:
    """Case-insensitive match of the pattern at the start of the priority; no priority is ''."""
    return F.coalesce(F.col(column), F.lit("")).rlike(f"(?i)^(?:{pattern})")


def remove_none(df: DataFrame, column: str) -> DataFrame:
    """Rows that have a value."""
    return df.where(F.col(column).isNotNull())


def prune_nulls(value: Column, kind: T.DataType) -> Column:
    """Drop null list elements and null map entries at every depth; empty containers stay.

    Null struct fields need no pruning: ``to_json`` leaves them out.
    """
    if isinstance(kind, T.StructType):
        fields = [prune_nulls(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        kept = F.filter(value, lambda x: x.isNotNull())
        return F.transform(kept, lambda x: prune_nulls(x, kind.elementType))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(value, lambda _, v: v.isNotNull())
        return F.transform_values(kept, lambda _, v: prune_nulls(v, kind.valueType))
    return value


def payload(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Rows as JSON request bodies without nulls."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return F.to_json(F.struct(*[prune_nulls(F.col(f.name), f.dataType).alias(f.name) for f in fields]))


def route(df: DataFrame, column: str, values: list[str], second_pass) -> DataFrame:
    """Send rows whose ``column`` is one of ``values`` through ``second_pass``; others go on unchanged."""
    chosen = F.coalesce(F.col(column).isin(values), F.lit(False))
    return df.where(~chosen).unionByName(second_pass(df.where(chosen)))


def header_lines(**headers: Column) -> Column:
    """``Name: value`` lines for the headers that are present."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers.items()]
    return F.concat_ws("\n", *lines)


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header with that name, whatever its case."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.try_element_at(hits, F.lit(1))["value"]


def numbered_url(id_: Column, number: Column) -> Column:
    """URL of the n-th item of a source."""
    return F.concat(id_.cast("string"), F.lit("#"), number.cast("string"))


def all_of(*conditions: Column) -> Column:
    """Conjunction."""
    return reduce(lambda a, b: a & b, conditions)
