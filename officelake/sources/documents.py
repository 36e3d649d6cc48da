"""Document JSON as tables: structural elements in order, and the nested ranges of everything in a document.

A document's body is a list of structural elements (paragraphs, tables, tables of contents, section breaks); a
paragraph has inline elements (text runs, chips, dates, objects), a cell has structural elements again. Nesting has no
limit, so levels are taken apart one after the other until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from officelake.session import ensure_checkpoints

#: Inline elements by the field that holds them, and what they count as in a text.
INLINE = {
    "textRun": "run", "person": "chip", "richLink": "chip", "dateElement": "date", "inlineObjectElement": "object",
    "pageBreak": "object", "columnBreak": "object", "horizontalRule": "object", "footnoteReference": "object",
    "autoText": "object", "equation": "object",
}
#: Structural elements likewise.
STRUCTURAL = {"paragraph": "paragraph", "table": "table", "tableOfContents": "contents", "sectionBreak": "section_break"}
RANGE_COLUMNS = ("doc_id", "start_index", "end_index", "depth", "kind", "content", "level", "heading_id", "place", "error")


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _list(v: Column, path: str) -> Column:
    return _get(v, path, "array<variant>")


def _kind(v: Column, kinds: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(_get(v, field).isNotNull(), kind) for field, kind in kinds.items()], F.lit("unknown"))


def _text(paragraph_of: Column) -> Column:
    """The text of all runs of a paragraph."""
    return F.array_join(F.transform(_list(paragraph_of, "paragraph.elements"), lambda x: F.coalesce(_get(x, "textRun.content", "string"), F.lit(""))), "")


def _bounds(v: Column) -> list[Column]:
    """Start (0 for the first element, which doesn't name it) and end."""
    return [F.coalesce(_get(v, "startIndex", "long"), F.lit(0).cast("long")).alias("start_index"), _get(v, "endIndex", "long").alias("end_index")]


def _parsed(df: DataFrame, text: str) -> DataFrame:
    v = F.try_parse_json(F.col(text))
    return df.select(v.alias("v"), F.col(text).alias("_source")).select(
        _get(F.col("v"), "documentId", "string").alias("doc_id"),
        _list(F.col("v"), "body.content").alias("content"),
        F.when(F.col("_source").isNotNull() & F.col("v").isNull(), "not a JSON document").alias("error"),
    )


def parse_documents(df: DataFrame, text: str) -> DataFrame:
    """One row per structural element of the body of document JSON texts; an empty body keeps one row with nulls.

    ``text`` is what a paragraph's runs say; tables and breaks have none here (see ``document_ranges``).
    """
    rows = _parsed(df, text).select("doc_id", F.posexplode_outer("content").alias("pos", "e"))
    e = F.col("e")
    return rows.select(
        "doc_id",
        "pos",
        *[F.when(F.col("pos").isNotNull(), c).alias(n) for c, n in zip(_bounds(e), ("start_index", "end_index"))],
        F.coalesce(_get(e, "paragraph.paragraphStyle.namedStyleType", "string"), F.lit("NORMAL_TEXT")).alias("level"),
        _get(e, "paragraph.paragraphStyle.headingId", "string").alias("heading_id"),
        F.when(_get(e, "paragraph").isNotNull(), _text(e)).alias("text"),
    )


def document_ranges(df: DataFrame, text: str) -> DataFrame:
    """One row per element at any depth: range, depth, kind, content, style, place (path of positions) and error.

    Kinds are those of ``INLINE`` and ``STRUCTURAL``, ``row`` and ``cell``. Elements of no known kind, and texts that
    are no JSON, are rows with an error. The runs, chips and dates are what ``sections.render_text`` takes.
    """
    ensure_checkpoints(df.sparkSession)
    parsed = _parsed(df, text)
    # parsed once: what is broken and what isn't come from the same rows
    start = parsed.select("doc_id", "error", F.posexplode_outer("content").alias("i", "e")).where("error IS NOT NULL OR i IS NOT NULL").checkpoint()
    broken = start.where(F.col("error").isNotNull())
    level = start.where(F.col("error").isNull()).select("doc_id", F.lit(1).alias("depth"), F.array("i").alias("place"), "e")
    found = [broken.select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in zip(RANGE_COLUMNS[1:-1], ("long", "long", "int", "string", "string", "string", "string", "array<int>"))], "error")]
    e = F.col("e")

    def rows(of: DataFrame, kind: Column, content: Column | None = None, styled: bool = False) -> DataFrame:
        none = F.lit(None).cast("string")
        return of.select(
            "doc_id", *_bounds(e), "depth", kind.alias("kind"), (none if content is None else content).alias("content"),
            (_get(e, "paragraph.paragraphStyle.namedStyleType", "string") if styled else none).alias("level"),
            (_get(e, "paragraph.paragraphStyle.headingId", "string") if styled else none).alias("heading_id"),
            "place", F.when(kind == "unknown", F.concat(F.lit("unknown element: "), F.to_json(e))).alias("error"),
        )

    def below(of: DataFrame, path: str, down: int = 1) -> DataFrame:
        inner = of.select("doc_id", "depth", "place", F.posexplode(_list(e, path)).alias("i", "e"))
        return inner.select("doc_id", (F.col("depth") + down).alias("depth"), F.concat("place", F.array("i")).alias("place"), "e")

    while level.limit(1).count():
        inline, table_rows = below(level, "paragraph.elements"), below(level, "table.tableRows")
        cells = below(table_rows, "tableCells")
        found += [
            rows(level, _kind(e, STRUCTURAL), styled=True),
            rows(inline, _kind(e, INLINE), _get(e, "textRun.content", "string")),
            rows(table_rows, F.lit("row")),
            rows(cells, F.lit("cell")),
        ]
        level = below(cells, "content").unionByName(below(level, "tableOfContents.content")).checkpoint()
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
