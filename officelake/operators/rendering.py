"""Pages as markdown, rendered by context: what a text lies in is a running sum over the page's rows.

The rows are those of ``elements.cleaned_rows``, whose tags are balanced. Block tags cut a page into blocks of text and
inline marks; lists, quotes, headings, code and table rows around a block say how it begins, and the block before it
how the two are parted. Windows are over the rows of one page, which came in as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from officelake.functions.mail import parse_mail
from officelake.operators.elements import attribute, clean_pages, cleaned_rows

HEADINGS = tuple(f"h{n}" for n in range(1, 7))
LISTS = ("ul", "ol")
CELLS = ("td", "th")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "head", "header", "html",
    "li", "main", "nav", "p", "pre", "section", "table", "tbody", "tfoot", "thead", "title", "tr", *LISTS, *HEADINGS,
)
#: Marks around inline elements, bullets by depth, what a list indents its content by, and entities.
INLINE = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`"}
CODE = ("code", "kbd", "samp")
BULLETS = "*+-"
WIDTHS = {"ul": 2, "ol": 3}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _plain(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def block_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, block, text, heading, quote, pre, marker, indent, cells, headed, part): every block that has text, in order.

    ``marker`` is an item's bullet or number at the block it begins with, ``indent`` what its list is indented by; ``part``
    names the list or table a block belongs to.
    """
    rows = cleaned_rows(pages, key, html)
    order = W.partitionBy(key).orderBy("n")
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("place"))).drop("place")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    depth = lambda names, weight=F.lit(1): F.sum(F.when(F.col("name").isin(*names), step * weight).otherwise(0)).over(order)
    level = F.coalesce(*[F.when(F.col("name") == h, k) for k, h in enumerate(HEADINGS, 1)], F.lit(0))
    width = F.coalesce(*[F.when(F.col("name") == n, w) for n, w in WIDTHS.items()], F.lit(0))
    rows = rows.withColumns(
        {
            "quote": depth(("blockquote",)), "pre": depth(("pre",)), "code": depth(CODE), "lists": depth(LISTS), "cell": depth(CELLS),
            "heading": depth(HEADINGS, level), "offset": depth(LISTS, width),
        }
    )
    breaks = F.col("name").isin(*BLOCKS) & F.col("kind").isin("open", "close") & (F.col("cell") == 0)
    opened = lambda names: F.when((F.col("kind") == "open") & F.col("name").isin(*names), F.struct("n", "name"))
    in_list = W.partitionBy(key, "lists").orderBy("n")
    rows = rows.withColumns(
        {
            "block": F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(order),
            "list": F.when(F.col("lists") > 0, F.last(opened(LISTS), ignorenulls=True).over(in_list)),
            "item": F.when(F.col("lists") > 0, F.last(opened(("li",)), ignorenulls=True).over(in_list)["n"]),
            "table": F.last(opened(("table",)), ignorenulls=True).over(order)["n"],
            "href": F.last(F.when((F.col("kind") == "open") & (F.col("name") == "a"), F.struct(attribute(F.col("token"), "href").alias("to"))), ignorenulls=True).over(order)["to"],
        }
    )
    begins = ((F.col("kind") == "open") & (F.col("name") == "li")).cast("int")
    rows = rows.withColumn("number", F.sum(begins).over(W.partitionBy(key, "list").orderBy("n")))
    words = F.regexp_replace("token", r"[ \t\r\n\f]+", " ")
    text = F.when(F.col("pre") > 0, F.col("token")).when(F.col("code") > 0, words).otherwise(F.regexp_replace(words, r"([*_])", r"\\$1"))
    mark = F.coalesce(*[F.when(F.col("name") == n, m) for n, m in INLINE.items()])
    piece = (
        F.when(F.col("kind") == "text", _plain(text))
        .when(mark.isNotNull() & (F.col("pre") == 0), mark)
        .when((F.col("name") == "a") & F.col("href").isNotNull(), F.when(F.col("kind") == "open", F.lit("[")).otherwise(F.concat(F.lit("]("), _plain(F.col("href")), F.lit(")"))))
        .when(F.col("name").isin(*CELLS), F.when(F.col("kind") == "open", F.lit("| ")).otherwise(F.lit(" ")))
        .otherwise("")
    )
    first = lambda c: F.min_by(c, "n").alias(c)
    is_cell = (F.col("kind") == "open") & F.col("name").isin(*CELLS)
    blocks = rows.where("kind <> 'mark'").groupBy(key, "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", piece.alias("piece")))), lambda x: x["piece"]), "").alias("text"),
        *[first(c) for c in ("heading", "quote", "pre", "lists", "offset", "list", "item", "number", "table")],
        F.count_if(is_cell).alias("cells"),
        F.count_if(is_cell & (F.col("name") == "th")).alias("headed"),
    )
    blocks = blocks.withColumn("text", F.when(F.col("pre") > 0, F.regexp_replace("text", r"^\n|\s+$", "")).otherwise(F.trim(F.regexp_replace("text", " {2,}", " "))))
    blocks = blocks.where(F.trim("text") != "")
    # the first block of an item has its marker
    leads = F.row_number().over(W.partitionBy(key, "item").orderBy("block")) == 1
    bullet = F.substring(F.lit(BULLETS), ((F.col("lists") - 1) % len(BULLETS) + 1).cast("int"), F.lit(1))
    marker = F.when(F.col("list.name") == "ol", F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise(F.concat(bullet, F.lit(" ")))
    own = F.coalesce(*[F.when(F.col("list.name") == n, w) for n, w in WIDTHS.items()], F.lit(0))
    return blocks.select(
        key, "block", "text", "heading", "quote", "pre",
        F.when(F.col("item").isNotNull() & leads, marker).alias("marker"),
        F.when(F.col("item").isNotNull() & leads, F.col("offset") - own).otherwise(F.col("offset")).alias("indent"),
        "cells", "headed",
        F.when(F.col("lists") > 0, "list").when(F.col("cells") > 0, F.concat(F.lit("table "), F.col("table").cast("string"))).alias("part"),
    )


def markdown_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, value, error): every page as markdown, ended by a line break; a page without any text is an error.

    Headings, paragraphs, nested and numbered lists, quotes, code blocks, tables, links, emphasis and code are kept;
    stars and underscores of the text are escaped. A null page is one without text.
    """
    blocks = block_rows(pages, key, html)
    quote = F.repeat(F.lit("> "), F.col("quote").cast("int"))
    indent = F.repeat(F.lit(" "), F.col("indent").cast("int"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("cells").cast("int")))
    text = (
        F.when(F.col("pre") > 0, F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .when(F.col("cells") > 0, F.concat(F.col("text"), F.lit(" |"), F.when(F.col("headed") > 0, rule).otherwise("")))
        .when(F.col("heading") > 0, F.concat(F.repeat(F.lit("#"), F.col("heading").cast("int")), F.lit(" "), F.col("text")))
        .otherwise(F.col("text"))
    )
    lead = F.concat(quote, indent, F.coalesce("marker", F.lit("")))
    below = F.concat(quote, indent, F.repeat(F.lit(" "), F.length(F.coalesce("marker", F.lit("")))))
    lines = F.concat(lead, F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), below)))
    before = W.partitionBy(key).orderBy("block")
    same_part = F.col("part").eqNullSafe(F.lag("part").over(before)) & F.col("part").isNotNull()
    both = F.least("quote", F.lag("quote").over(before))
    blank = F.concat(F.lit("\n"), F.rtrim(F.repeat(F.lit("> "), F.coalesce(both, F.lit(0)).cast("int"))), F.lit("\n"))
    parted = F.when(F.lag("block").over(before).isNull(), "").when(same_part, "\n").otherwise(blank)
    joined = blocks.select(key, "block", F.concat(parted, lines).alias("line")).groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "line"))), lambda x: x["line"]), "").alias("value")
    )
    out = pages.select(key).join(joined, key, "left")
    error = F.when(F.col("value").isNull(), "the page has no text")
    return out.select(key, F.concat("value", F.lit("\n")).alias("value"), error.alias("error"))


def convert_pages(rows: DataFrame, key: str, content: str, source: Column, target: Column) -> DataFrame:
    """(key, value, error): contents from one media type in another, where there is a way; see ``markdown_pages``."""
    marked = rows.select(key, content, source.alias("_source"), target.alias("_target"))
    html = F.col("_source") == "text/html"
    ways = {"text/markdown": markdown_pages, "text/x-clean-html": lambda p, k, c: clean_pages(p, k, c, "value").withColumn("error", F.lit(None).cast("string"))}
    same = F.col("_source") == F.col("_target")
    out = marked.where(same).select(key, F.col(content).alias("value"), F.lit(None).cast("string").alias("error"))
    for kind, way in ways.items():
        out = out.unionByName(way(marked.where(html & (F.col("_target") == kind) & ~same), key, content))
    known = same | (html & F.col("_target").isin(*ways))
    error = F.concat(F.lit("no way from "), F.col("_source"), F.lit(" to "), F.col("_target"))
    return out.unionByName(marked.where(~F.coalesce(known, F.lit(False))).select(key, F.lit(None).cast("string").alias("value"), error.alias("error")))


def mail_bodies(mails: DataFrame, key: str, raw: str, output: str = "text/markdown") -> DataFrame:
    """(key, value, error): the main body of raw mails, html converted to ``output``, plain text as it is."""
    parsed = mails.select(key, parse_mail(F.col(raw)).alias("p")).select(key, "p.body_type", "p.body", "p.error")
    is_html = F.coalesce(F.col("body_type") == "text/html", F.lit(False))
    html = convert_pages(parsed.where(is_html), key, "body", F.lit("text/html"), F.lit(output))
    return html.unionByName(parsed.where(~is_html).select(key, F.col("body").alias("value"), "error"))
