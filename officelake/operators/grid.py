"""Grid rows: merged cell values, empty-row cut-off, normalisation and named fields.

Rows are ``(keys…, start_row, row_num, values)`` with ragged ``values`` of tagged cells. A single sheet may hold
most rows, so nothing here puts a whole grid into one task: rows are windowed in blocks of row numbers and
joined with one small row per block or per grid.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any, Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 65_536
_VARIANTS = {
    "number": "numberValue",
    "string": "stringValue",
    "bool": "boolValue",
    "formula": "formulaValue",
    "error": "errorValue",
}


def merged_value(cell: Column) -> Column:
    """struct<kind, value, error>: the one value a cell holds as text, or an error when it holds several."""
    present = [cell[f].isNotNull().cast("int") for f in _VARIANTS.values()]
    count = reduce(lambda a, b: a + b, present)
    kind = F.coalesce(*[F.when(cell[f].isNotNull(), F.lit(k)) for k, f in _VARIANTS.items()])
    texts = [cell[f] if f != "errorValue" else F.to_json(cell[f]) for f in _VARIANTS.values()]
    value = F.coalesce(*[t.cast("string") for t in texts])
    several = count > 1
    return F.struct(
        F.when(~several, kind).alias("kind"),
        F.when(~several, value).alias("value"),
        F.when(several, F.lit("Only one value may be set")).alias("error"),
    )


def value_text(cell: Column) -> Column:
    """The merged value of a cell as text."""
    return merged_value(cell)["value"]


def cell_is_empty(cell: Column) -> Column:
    """Whether a cell has no value, or ''."""
    others = [cell[f].isNull() for f in _VARIANTS.values() if f != "stringValue"]
    return reduce(lambda a, b: a & b, others, cell.isNull() | (F.coalesce(cell["stringValue"], F.lit("")) == ""))


def row_is_empty(values: Column) -> Column:
    """Whether every cell is null or ''."""
    return F.forall(F.coalesce(values, F.array()), cell_is_empty)


def used_rows(
    rows: DataFrame,
    keys: list[str],
    accepted: int = 0,
    include_empty: bool = False,
    first_row: int | None = None,
    is_empty: Callable[[Column], Column] = row_is_empty,
    block: int = BLOCK,
    bounded: bool = False,
) -> DataFrame:
    """Rows before the first run of more than ``accepted`` empty rows; empty ones only on request.

    Grids of any length are worked on in blocks; a caller whose grids came in as one row each says ``bounded`` and
    gets one sort per grid instead.
    """
    if first_row is not None:
        rows = rows.where(F.col("row_num") >= first_row)
    rows = rows.withColumn("_empty", is_empty(F.col("values")))
    filled = F.when(~F.col("_empty"), F.col("row_num"))
    if bounded:
        so_far = W.partitionBy(*keys).orderBy("row_num").rowsBetween(W.unboundedPreceding, W.currentRow)
        before_all = F.first("row_num").over(so_far) - 1
        run = rows.withColumn("_run", F.col("row_num") - F.coalesce(F.max(filled).over(so_far), before_all))
        out = run.withColumn("_over", F.max(F.col("_run") > accepted).over(so_far)).where(~F.col("_over"))
        return (out if include_empty else out.where(~F.col("_empty"))).drop("_empty", "_run", "_over")
    rows = rows.withColumn("_block", F.expr(f"row_num div {block}"))
    # The last filled row before a block comes from one summary row per block.
    summary = rows.groupBy(*keys, "_block").agg(F.max(filled).alias("_last"), F.min("row_num").alias("_lo"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    summary = summary.select(
        *keys,
        "_block",
        F.coalesce(F.max("_last").over(before), F.min("_lo").over(whole) - 1).alias("_carry"),
    )
    upto = W.partitionBy(*keys, "_block").orderBy("row_num").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.withColumn("_prev", F.max(filled).over(upto)).join(summary, [*keys, "_block"])
    run = run.withColumn("_run", F.col("row_num") - F.coalesce("_prev", "_carry"))
    stops = run.where(F.col("_run") > accepted).groupBy(*keys).agg(F.min("row_num").alias("_stop"))
    out = run.join(stops, keys, "left").where(F.col("_stop").isNull() | (F.col("row_num") < F.col("_stop")))
    if not include_empty:
        out = out.where(~F.col("_empty"))
    return out.drop("_empty", "_block", "_prev", "_carry", "_run", "_stop")


def bad_first_row(rows: DataFrame, keys: list[str], first_row: int) -> DataFrame:
    """Grids that start after the requested first row, which is an error."""
    return rows.groupBy(*keys).agg(F.min("start_row").alias("start_row")).where(F.col("start_row") > first_row)


def normalise(rows: DataFrame, keys: list[str], width: int | Column | None = None) -> DataFrame:
    """Pad or clip every row to the widest row of its grid, or to ``width``."""
    if width is None:
        widths = rows.groupBy(*keys).agg(F.max(F.size("values")).alias("_w"))
        rows = rows.join(widths, keys)
    else:
        rows = rows.withColumn("_w", width if isinstance(width, Column) else F.lit(width))
    kind = rows.schema["values"].dataType.elementType
    pad = F.array_repeat(F.lit(None).cast(kind), F.greatest(F.col("_w") - F.size("values"), F.lit(0)))
    return rows.withColumn("values", F.concat(F.slice("values", 1, F.col("_w")), pad)).drop("_w")


@dataclass(frozen=True)
class Field:
    """How a column becomes a field; the default stands for a missing cell, not for an empty one."""

    name: str | None
    convert: Callable[[Column], Column] = value_text
    default: Any = None


def to_fields(rows: DataFrame, keys: list[str], fields: list[str | Field | None], row_number: str | None = None) -> DataFrame:
    """Rows with named fields by position; ``None`` skips a column."""
    out = []
    for i, f in enumerate(fields):
        f = Field(f) if isinstance(f, str) else f
        if f is None or f.name is None:
            continue
        cell = F.try_element_at("values", F.lit(i + 1))
        value = F.when(F.size("values") > i, f.convert(cell))
        out.append((value if f.default is None else value.when(F.size("values") <= i, F.lit(f.default))).alias(f.name))
    if row_number:
        out.append(F.col("row_num").alias(row_number))
    return rows.select(*keys, *out)


def header_fields(rows: DataFrame, header_row: int) -> list[str | None]:
    """Field names from one row of one grid, the only row that comes to the driver; empty names skip."""
    names = F.transform("values", lambda c: value_text(c))
    found = rows.where(F.col("row_num") == header_row).select(names.alias("n")).limit(1).collect()
    if not found:
        raise ValueError(f"no header row {header_row}")
    return [n or None for n in found[0]["n"]]


def with_header(rows: DataFrame, keys: list[str], header_row: int, start_row: int | None = None) -> DataFrame:
    """Rows below the header named by it."""
    first = header_row + 1 if start_row is None else start_row
    return to_fields(rows.where(F.col("row_num") >= first), keys, header_fields(rows, header_row))
