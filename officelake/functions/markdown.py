"""Markdown text to block rows: lines are rows, blocks are runs of lines, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HEADING = r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$"
ITEM = r"^(\s*)(?:[*+-]|\d+[.)])\s+(.*)$"
INDENTED = r"^(\.{3,})\s+(.*)$"
#: Marks that open and close a span, and the span's style; of marks that begin alike the longer one comes first.
MARKS = {"**": "strong", "__": "strong", "~~": "strike", "*": "em", "_": "em"}
LINK = r"\[([^\]]*)\]\(([^)\s]*)\)"
ESCAPE = r"\\[\\`*_~\[\]()#+.!-]"
#: An escaped character, code, a link, a mark, plain text, or any other character.
TOKEN = rf"{ESCAPE}|`[^`]++`|{LINK}|\*\*|__|~~|\*|_|[^\\`\[*_~]++|(?s:.)"
SPAN = "array<struct<start:int,end:int,style:string,url:string>>"


def units(text: Column) -> Column:
    """Length in UTF-16 units, as document positions count."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _paired(tokens: Column) -> Column:
    """array<struct<a, b, style>>: the places of marks that open and close a span.

    A mark opens before something that is no space and closes behind such; one of underscores does neither inside a
    word. Each kind of mark is open once at a time, so spans of different kinds may lie in or across each other; a
    mark that finds no partner is text.
    """
    none = F.array().cast("array<struct<a:int,b:int,style:string>>")
    start = F.struct(*[F.lit(-1).alias(f"o{k}") for k in range(len(MARKS))], none.alias("pairs"))
    around = lambda i: F.struct(F.get(tokens, i).alias("t"), F.coalesce(F.get(tokens, i - 1), F.lit("")).alias("before"), F.coalesce(F.get(tokens, i + 1), F.lit("")).alias("after"), i.alias("i"))

    def step(acc: Column, x: Column) -> Column:
        word_before, word_after = x["before"].rlike(r"[\p{L}\p{N}]$"), x["after"].rlike(r"^[\p{L}\p{N}]")
        opens, closes = x["after"].rlike(r"^\S"), x["before"].rlike(r"\S$")
        fields, pairs = [], acc["pairs"]
        for k, (mark, style) in enumerate(MARKS.items()):
            inside = F.lit(False) if mark[0] != "_" else word_before & word_after
            can_open, can_close = opens & ~inside, closes & ~inside
            is_open, here = acc[f"o{k}"] >= 0, x["t"] == mark
            fields.append(F.when(here & is_open & can_close, -1).when(here & ~is_open & can_open, x["i"]).otherwise(acc[f"o{k}"]).alias(f"o{k}"))
            pairs = F.when(here & is_open & can_close, F.concat(pairs, F.array(F.struct(acc[f"o{k}"].alias("a"), x["i"].alias("b"), F.lit(style).alias("style"))))).otherwise(pairs)
        return F.struct(*fields, pairs.alias("pairs"))

    marks = F.filter(F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), around), lambda x: x["t"].isin(*MARKS))
    return F.aggregate(marks, start, step, lambda acc: acc["pairs"])


def inline(text: Column) -> Column:
    """struct<text, spans>: strong, emphasised, struck, code and linked parts without their marks, and where they stand.

    Spans are sorted by start, outer ones first. Escaped marks and those without a partner are text.
    """

    def rendered(tokens: Column, pairs: Column) -> Column:
        matched = F.concat(F.transform(pairs, lambda p: p["a"]), F.transform(pairs, lambda p: p["b"]))

        def piece(t: Column, i: Column) -> Column:
            code, link = t.rlike("^`[^`]+`$"), t.rlike(rf"^{LINK}$")
            shown = (
                F.when(F.array_contains(matched, i), "")
                .when(t.rlike(rf"^{ESCAPE}$"), F.substring(t, F.lit(2), F.lit(1)))
                .when(code, F.substring(t, F.lit(2), F.length(t) - 2))
                .when(link, F.regexp_extract(t, LINK, 1))
                .otherwise(t)
            )
            return F.struct(
                shown.alias("shown"), units(shown).alias("size"), F.when(code, "code").when(link, "link").alias("style"),
                F.when(link, F.regexp_extract(t, LINK, 2)).alias("url"),
            )

        def spanned(pieces: Column) -> Column:
            ends = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["size"])))

            def placed(at: Column) -> Column:
                span = lambda a, b, style, url: F.struct(a.alias("start"), b.alias("end"), style.alias("style"), url.alias("url"))
                none = F.lit(None).cast("string")
                marked = F.transform(pairs, lambda p: span(F.get(at, p["a"]), F.get(at, p["b"]), p["style"], none))
                own = F.transform(pieces, lambda p, i: F.when(p["style"].isNotNull(), span(F.get(at, i), F.get(at, i + 1), p["style"], p["url"])))
                ranked = F.transform(F.concat(marked, F.array_compact(own)), lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("e"), x.alias("x")))
                return F.transform(F.array_sort(ranked), lambda r: r["x"])

            return F.struct(F.array_join(F.transform(pieces, lambda p: p["shown"]), "").alias("text"), _let(ends, placed).cast(SPAN).alias("spans"))

        return _let(F.transform(tokens, piece), spanned)

    plain = F.struct(text.alias("text"), F.array().cast(SPAN).alias("spans"))
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    parsed = _let(tokens, lambda t: _let(_paired(t), lambda p: rendered(t, p)))
    return F.when(text.rlike(r"[\\`\[*_~]"), parsed).otherwise(plain)


def item_levels(blocks: DataFrame, key: str) -> DataFrame:
    """``blocks`` (with block, kind and indent) with the level of each item: how many items it lies in.

    The items of a list are folded with the indents they lie in as a stack: an item leaves those that are not
    indented less. Other blocks begin a new list, unless they are indented too.
    """
    listed = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", "kind", "indent"))).alias("all"))
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<block:bigint,level:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        within = F.filter(acc["open"], lambda i: i < x["indent"])
        item = x["kind"] == "list_item"
        return F.struct(
            F.when(item, F.concat(within, F.array(x["indent"]))).when(x["indent"] > 0, acc["open"]).otherwise(F.array().cast("array<int>")).alias("open"),
            F.when(item, F.concat(acc["out"], F.array(F.struct(x["block"].cast("bigint").alias("block"), F.size(within).alias("level"))))).otherwise(acc["out"]).alias("out"),
        )

    levels = listed.select(key, F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("l")).select(key, F.col("l.block").alias("block"), F.col("l.level").alias("depth"))
    return blocks.join(levels, [key, "block"], "left").withColumn("level", F.coalesce("depth", "level")).drop("depth", "indent")


def block_rows(df: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """One row per block with its number, kind, level, text and spans.

    Headings are blocks of one line; an item, an indented block (dots) or a paragraph goes on over plain lines up to a
    blank one. An item's level is the number of items it is indented in. A line that ends in two spaces keeps its break as a
    vertical tab. Windows are over the lines of one document, which came in as one row.
    """
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    line = F.col("line")
    kind = (
        F.when(F.trim(line) == "", "blank")
        .when(line.rlike(HEADING), "heading")
        .when(line.rlike(ITEM), "list_item")
        .when(line.rlike(INDENTED), "indented")
        .otherwise("text")
    )
    order = Window.partitionBy(key).orderBy("line_no")
    before = F.lag("kind").over(order)
    opens = F.col("kind").isin("heading", "list_item", "indented") | (
        (F.col("kind") == "text") & (before.isNull() | before.isin("blank", "heading"))
    )
    lines = lines.withColumn("kind", kind).withColumn("opens", opens.cast("int")).withColumn("block", F.sum("opens").over(order))
    level = (
        F.when(F.col("kind") == "heading", F.length(F.regexp_extract(line, HEADING, 1)))
        .when(F.col("kind") == "indented", F.length(F.regexp_extract(line, INDENTED, 1)))
        .otherwise(0)
    )
    bare = (
        F.when(F.col("kind") == "heading", F.regexp_extract(line, HEADING, 2))
        .when(F.col("kind") == "list_item", F.regexp_extract(line, ITEM, 2))
        .when(F.col("kind") == "indented", F.regexp_extract(line, INDENTED, 2))
        .otherwise(F.regexp_replace(line, r"^\s+", ""))
    )
    joint = F.when(line.endswith("  "), "\v").otherwise(" ")
    indent = F.length(F.regexp_replace(F.regexp_extract(line, r"^(\s*)", 1), "\t", "    "))
    rows = lines.where("kind <> 'blank'").select(key, "block", "line_no", "kind", level.cast("int").alias("level"), indent.alias("indent"), F.rtrim(bare).alias("bare"), joint.alias("joint"))
    blocks = rows.groupBy(key, "block").agg(
        F.min_by("kind", "line_no").alias("kind"),
        F.min_by("level", "line_no").alias("level"),
        F.min_by("indent", "line_no").alias("indent"),
        F.sort_array(F.collect_list(F.struct("line_no", "bare", "joint"))).alias("lines"),
    )
    blocks = item_levels(blocks, key)
    whole = F.array_join(F.transform("lines", lambda x: F.concat(x["bare"], x["joint"])), "")
    done = blocks.withColumn("inline", inline(F.substring(whole, F.lit(1), F.length(whole) - 1)))
    done = done.where("inline.text <> ''")
    number = F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1
    return done.select(
        key,
        number.cast("int").alias("block_no"),
        F.when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind")).alias("kind"),
        "level",
        "inline.text",
        "inline.spans",
    )
