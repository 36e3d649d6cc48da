"""Bindings: sheet grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from officelake.catalog import query
from officelake.operators import grid
from officelake.operators.ordering import ordinal
from officelake.plans import inputs
from officelake.plans.inputs import table
from officelake.schemas import CELL_VALUE


def _cell(**value):
    fields = [value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CELL_VALUE.fields]
    return F.struct(*fields)


def _grid(spark, sf):
    """A grid per order from row 2 on: ragged cells, blank rows for returned lines."""
    rows = ordinal(table(spark, sf, "lineitem"), ["l_orderkey"], [F.col(c) for c in inputs.LINE_ORDER], "_n", bounded=True)
    full = F.array(
        _cell(numberValue=F.col("l_quantity")),
        _cell(stringValue=F.col("l_linestatus")),
        _cell(boolValue=F.col("l_discount") > 0.05),
        _cell(formulaValue=F.concat(F.lit("=A"), F.col("l_linenumber").cast("string"))),
    )
    blank = F.array(_cell(), _cell(stringValue=F.lit("")), _cell(), _cell())
    width = 1 + F.col("l_linenumber") % 4
    values = F.slice(F.when(F.col("l_returnflag") == "A", blank).otherwise(full), 1, width)
    return rows.select(
        F.col("l_orderkey").alias("grid"), F.lit(2).alias("start_row"), (F.col("_n") + 2).alias("row_num"), values.alias("values")
    )


GRID_SQL = """g AS (SELECT l_orderkey AS grid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
      l_suppkey, l_quantity, l_extendedprice, l_shipdate) + 1 AS row_num, l_returnflag = 'A' AS empty, 1 + l_linenumber % 4 AS width,
      CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS VARCHAR) END AS c1,
      CASE WHEN l_returnflag <> 'A' THEN l_linestatus ELSE '' END AS c2,
      CASE WHEN l_returnflag <> 'A' THEN CAST(l_discount > 0.05 AS VARCHAR) END AS c3,
      CASE WHEN l_returnflag <> 'A' THEN '=A' || l_linenumber END AS c4 FROM lineitem),
   r AS (SELECT *, row_num - coalesce(max(CASE WHEN NOT empty THEN row_num END) OVER (PARTITION BY grid ORDER BY row_num), 1) AS run FROM g),
   s AS (SELECT grid, min(row_num) AS stop FROM r WHERE run > 1 GROUP BY grid),
   used AS (SELECT r.* FROM r LEFT JOIN s USING (grid) WHERE stop IS NULL OR row_num < stop)"""


@query(
    "n7_merged_cell_value",
    f"""WITH {GRID_SQL}, c AS (
          SELECT grid, row_num, unnest([1, 2, 3, 4][:width]) AS col, empty, c1, c2, c3, c4 FROM g)
        SELECT grid, row_num, col, CASE WHEN empty AND col <> 2 THEN NULL WHEN col = 1 THEN 'number' WHEN col = 2 THEN 'string' WHEN col = 3 THEN 'bool'
               END AS kind, CASE col WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 END AS value,
               CASE WHEN col = 4 AND NOT empty THEN 'Only one value may be set' END AS error FROM c""",
)
def n7(spark, sf):
    cells = _grid(spark, sf).select("grid", "row_num", F.posexplode("values").alias("col", "cell"))
    # A formula cell that also holds a number breaks the one-value rule.
    formula = F.col("cell.formulaValue").isNotNull()
    cell = F.when(formula, F.col("cell").withField("numberValue", F.lit(1.0))).otherwise(F.col("cell"))
    out = cells.select("grid", "row_num", (F.col("col") + 1).alias("col"), grid.merged_value(cell).alias("v"))
    return out.select("grid", "row_num", "col", "v.*")


@query(
    "w6_used_rows",
    f"""WITH {GRID_SQL} SELECT grid, row_num, 'plain' AS mode FROM used WHERE NOT empty
        UNION ALL SELECT grid, row_num, 'empty' FROM used""",
)
def w6(spark, sf):
    rows = _grid(spark, sf)
    used = grid.used_rows(rows, ["grid"], accepted=1, include_empty=True, bounded=True)
    # without the empty ones, what is left is the same rows but these
    modes = F.when(grid.row_is_empty(F.col("values")), F.array(F.lit("empty"))).otherwise(F.array(F.lit("plain"), F.lit("empty")))
    return used.select("grid", "row_num", F.explode(modes).alias("mode"))


@query(
    "w7_normalise_rows",
    f"""WITH {GRID_SQL} SELECT grid, row_num, CAST(max(width) OVER (PARTITION BY grid) AS INT) AS width,
        CASE WHEN width >= 2 THEN c2 END AS second FROM g""",
)
def w7(spark, sf):
    out = grid.normalise(_grid(spark, sf), ["grid"])
    second = grid.value_text(F.try_element_at("values", F.lit(2)))
    return out.select("grid", "row_num", F.size("values").alias("width"), second.alias("second"))


@query(
    "p10_rows_to_fields",
    f"""WITH {GRID_SQL} SELECT grid, row_num AS row, c1 AS quantity, CASE WHEN width >= 3 THEN c3 ELSE 'none' END AS cheap,
        CASE WHEN width >= 4 THEN length(c4) END AS size FROM g""",
)
def p10(spark, sf):
    fields = [
        "quantity",
        None,
        grid.Field("cheap", default="none"),
        grid.Field("size", lambda c: F.length(grid.value_text(c)).cast("long")),
    ]
    return grid.to_fields(_grid(spark, sf), ["grid"], fields, "row")


@query("p11_header_row", "SELECT p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_partkey >= 3")
def p11(spark, sf):
    def cells(*texts):
        return F.array(*[_cell(stringValue=t) for t in texts])

    p = table(spark, sf, "part")
    body = p.select(
        (F.col("p_partkey") + 1).alias("row_num"),
        cells(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_size").cast("string")).alias("values"),
    )
    names = cells(*[F.lit(n) for n in ("name", "", "brand", "size")])
    header = p.agg(F.lit(0).cast("long").alias("row_num"), F.first(names).alias("values"))
    return grid.with_header(header.unionByName(body), [], 0, start_row=4)


@query(
    "e2e7_sheet_extract",
    """WITH l AS (SELECT doc_id, i, string_split(string_split(text, chr(10))[i + 1], ' ') AS w
                  FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
       e AS (SELECT *, len(list_filter(w, lambda x: x <> '')) = 0 AS empty, max(len(w)) OVER (PARTITION BY doc_id) AS width FROM l),
       s AS (SELECT doc_id, min(i) AS stop FROM e WHERE empty GROUP BY doc_id)
       SELECT '{"row":' || (i + 3) || ',"first":"' || w[1] || '"' || CASE WHEN len(w) >= 3 AND w[3] <> '' THEN ',"third":"' || w[3] || '"' ELSE '' END || '}' AS json
       FROM e LEFT JOIN s USING (doc_id) WHERE stop IS NULL OR i < stop""",
)
def e2e7(spark, sf):
    from officelake.catalog.scans import _book
    from officelake.plans.jobs import sheet_extract

    return sheet_extract(_book(spark, sf), "json", ["doc_id"], ["first", None, "third"], "row")
