"""Spreadsheet JSON as cell and row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from officelake.schemas import SPREADSHEET


def parse_spreadsheets(df: DataFrame, text: str) -> DataFrame:
    """Spreadsheet JSON text as the typed struct ``book``; fields the schema does not know are dropped."""
    return df.withColumn("book", F.from_json(F.col(text), SPREADSHEET)).drop(text)


def _explode(df: DataFrame, pos: str, item: str) -> DataFrame:
    """Items of the list ``_v`` with their position.

    The outer form is used because for the plain one the optimizer infers a filter on the list's size, which
    it pushes down to where the JSON is parsed and so parses it twice.
    """
    rest = [c for c in df.columns if c != "_v"]
    return df.select(*rest, F.posexplode_outer("_v").alias(pos, item)).where(F.col(pos).isNotNull())


def grid_rows(df: DataFrame) -> DataFrame:
    """One row per grid row: sheet and grid numbers, row number with the grid offset, ragged ``values``.

    ``width`` is the widest row of the grid, known here while the grid is still one value.
    """
    keys = [c for c in df.columns if c != "book"]
    sheets = _explode(df.select(*keys, F.col("book.sheets").alias("_v")), "sheet", "_s")
    grids = _explode(sheets.select(*keys, "sheet", F.col("_s.data").alias("_v")), "grid", "_g")
    # Everything taken from the grid as a whole is taken before its rows are exploded, or every row would
    # carry the whole grid.
    grids = grids.select(
        *keys,
        "sheet",
        "grid",
        F.coalesce("_g.startRow", F.lit(0)).alias("start_row"),
        F.array_max(F.transform("_g.rowData", lambda r: F.size(F.coalesce(r["values"], F.array())))).alias("width"),
        F.col("_g.rowData").alias("_v"),
    )
    rows = _explode(grids, "_r", "_row")
    values = F.transform(F.coalesce("_row.values", F.array()), lambda c: c["effectiveValue"])
    return rows.select(
        *keys, "sheet", "grid", "start_row", "width", (F.col("start_row") + F.col("_r")).alias("row_num"), values.alias("values")
    )


def grid_cells(df: DataFrame) -> DataFrame:
    """One row per cell."""
    rows = grid_rows(df)
    keys = [c for c in rows.columns if c not in ("values", "start_row", "width")]
    return _explode(rows.select(*keys, F.col("values").alias("_v")), "col_num", "cell")
