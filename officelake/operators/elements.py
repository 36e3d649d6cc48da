"""Web pages as rows of marks and texts, elements as nested intervals of them, and cleaning by what an element holds.

A page is taken apart once by a pattern. One fold over its tags, with the open ones as a stack, says where each element
ends; everything else is sums over positions, which say what text an element holds and which elements a row lies in,
without following any nesting. Folds and windows are over the rows of one page, which came in as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from officelake.session import pin_columns

#: Attributes that go, elements that stay without text, and elements that go with their text.
LAYOUT_ATTRIBUTES = ("class", "align", "border", "cellpadding", "cellspacing", "id", "background", "role", "type", "valign")
KEPT_EMPTY = ("document", "head", "body")
DROPPED = ("script", "style")
#: Style properties that go, whole names first, then beginnings, then parts.
STYLES = ("hyphens", "float", "opacity", "text-decoration", "overflow", "visibility", "font-family", "white-space", "font", "display")
STYLE_STARTS = ("-", "word-", "mso-")
STYLE_PARTS = ("background", "align", "border", "padding", "margin", "spacing", "width", "height", "line")
#: Elements that have no content and no closing tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: A text counts if it has one of these.
LETTER = "[A-Za-z0-9]"

_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TOKEN = rf"(?is)<!--.*?-->|<(?:script|style)\b{_INSIDE}>.*?</(?:script|style)\s*+>|<![^>]*+>|</?[a-z]{_INSIDE}>|[^<]++|<"
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""


def page_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, token, kind, name): the marks and texts of every page in order; nothing for a null or empty one.

    Kinds are open, close, void (with no content), text, mark (a document type) and gone (comments, scripts, styles).
    """
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    token = F.col("token")
    name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
    kind = (
        F.when(token.startswith("<!--") | (name.isin(*DROPPED) & token.rlike(r"(?is)</(?:script|style)\s*>$") & ~token.startswith("</")), "gone")
        .when(token.startswith("<!"), "mark")
        .when(name == "", "text")
        .when(token.startswith("</"), "close")
        .when(name.isin(*VOID) | token.endswith("/>"), "void")
        .otherwise("open")
    )
    return rows.select(key, "pos", "token", kind.alias("kind"), F.when(kind.isin("open", "close", "void"), name).alias("name"))


_OPEN = "array<struct<pos:int,name:string>>"
_ENDED = "array<struct<pos:int,stop:int,closed:boolean>>"
#: Tags that are folded at once: a list that grows is copied at every step.
BLOCK = 512


def ended(tags: Column) -> Column:
    """array<struct<pos, stop, closed>>: where every element of a page's tags (pos, name, open) ends.

    A closing tag ends the last open element of its name and all that were opened in it since, which have no closing
    tag of their own; it ends nothing if there is none. Elements still open at the end have no ``stop``.
    """
    none = F.array().cast(_ENDED)

    def step(acc: Column, t: Column) -> Column:
        open_, back = acc["open"], F.array_position(F.reverse(F.transform(acc["open"], lambda x: x["name"])), t["name"]).cast("int")
        closes = ~t["open"] & (back > 0)
        at = F.size(open_) - back
        popped = F.transform(F.slice(open_, at + 1, back), lambda x, i: F.struct(x["pos"], t["pos"].alias("stop"), (i == 0).alias("closed")))
        return F.struct(
            F.when(t["open"], F.concat(open_, F.array(F.struct(t["pos"].alias("pos"), t["name"].alias("name")))))
            .when(closes, F.slice(open_, F.lit(1), at))
            .otherwise(open_)
            .cast(_OPEN)
            .alias("open"),
            F.when(closes, F.concat(acc["ended"], popped)).otherwise(acc["ended"]).cast(_ENDED).alias("ended"),
        )

    def block(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["open"].alias("open"), none.alias("ended")), step)
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["open"].alias("open"), F.concat(acc["parts"], F.array(d["ended"])).alias("parts"))), F.lit(0))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(tags) - 1) / BLOCK).cast("int")), lambda k: F.slice(tags, k * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast(f"array<{_ENDED}>").alias("parts"))
    rest = lambda acc: F.transform(acc["open"], lambda x: F.struct(x["pos"], F.lit(None).cast("int").alias("stop"), F.lit(False).alias("closed")))
    return F.aggregate(blocks, start, block, lambda acc: F.concat(F.flatten(acc["parts"]), rest(acc).cast(_ENDED)))


def elements(rows: DataFrame, key: str) -> DataFrame:
    """(key, start, stop, closed, name, token, texts): every element with the place its closing tag has, or would have.

    ``texts`` counts the texts with a letter or digit inside. Closing tags that match nothing belong to no element.
    """
    counts = ((F.col("kind") == "text") & F.col("token").rlike(LETTER)).cast("long")
    rows = rows.withColumn("upto", F.sum(counts).over(W.partitionBy(key).orderBy("pos")))
    whole = rows.groupBy(key).agg(
        (F.max("pos") + 1).alias("beyond"),
        F.max("upto").alias("all"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin("open", "close"), F.struct("pos", "name", (F.col("kind") == "open").alias("open"))))).alias("tags"),
    )
    ends = whole.where(F.size("tags") > 0).select(key, "beyond", "all", F.explode(ended(F.col("tags"))).alias("e")).select(key, "beyond", "all", F.col("e.pos").alias("pos"), "e.stop", "e.closed")
    there = rows.select(key, F.col("pos").alias("stop"), F.col("upto").alias("there"))
    found = rows.where("kind = 'open'").join(ends, [key, "pos"]).join(there, [key, "stop"], "left")
    found = found.select(
        key,
        F.col("pos").alias("start"),
        F.coalesce("stop", "beyond").alias("stop"),
        "closed",
        "name",
        "token",
        (F.coalesce("there", "all") - F.col("upto")).alias("texts"),
    )
    void = rows.where("kind = 'void'").select(key, F.col("pos").alias("start"), F.col("pos").alias("stop"), F.lit(True).alias("closed"), "name", "token", F.lit(0).cast("long").alias("texts"))
    return found.unionByName(void)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, null without it."""
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 0)
    value = F.regexp_replace(F.regexp_replace(found, rf"(?is)^\s{name}\s*=\s*", ""), r"""^["']|["']$""", "")
    return F.when(found != "", value)


def declarations(style: Column) -> Column:
    """map of a style's properties to their values, without importance."""
    items = F.filter(F.split(style, r"\s*;\s*"), lambda s: s.rlike(r"(?s)^\s*\S+?\s*:"))
    name = lambda s: F.trim(F.regexp_extract(s, r"(?s)^\s*(\S+?)\s*:", 1))
    value = lambda s: F.regexp_extract(s, r"(?s)^\s*\S+?\s*:\s*(.*?)(\s*!.*)?$", 1)
    return F.transform(items, lambda s: F.struct(name(s).alias("name"), value(s).alias("value")))


def hidden(tag: Column) -> Column:
    """Whether a tag's style hides its element."""
    found = declarations(F.coalesce(attribute(tag, "style"), F.lit("")))
    return F.exists(found, lambda d: ((d["name"] == "display") & (d["value"] == "none")) | ((d["name"] == "visibility") & (d["value"] == "hidden")))


def bare_tag(tag: Column) -> Column:
    """A tag without attributes that only lay out a page; of its style the other properties stay."""
    name = lambda d: F.lower(d["name"])
    gone = lambda d: name(d).isin(*STYLES) | name(d).rlike("^(?:" + "|".join(STYLE_STARTS) + ")") | name(d).rlike("|".join(STYLE_PARTS))
    kept = F.filter(declarations(attribute(tag, "style")), lambda d: ~gone(d))
    style = F.array_join(F.transform(kept, lambda d: F.concat(d["name"], F.lit(":"), d["value"])), ";")
    plain = F.regexp_replace(tag, rf"(?is)\s+(?:{'|'.join(LAYOUT_ATTRIBUTES)})(?![\w-]){_VALUE}", "")
    without = F.regexp_replace(plain, rf"(?is)\s+style{_VALUE}", "")
    with_style = F.concat(F.regexp_extract(without, r"(?s)^(.*?)\s*/?>$", 1), F.lit(' style="'), style, F.lit('"'), F.regexp_extract(without, r"(/?>)$", 1))
    return F.when(attribute(tag, "style").isNull(), plain).when(style == "", without).otherwise(with_style)


def cleaned_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, token, kind, name): the rows of every page that has text, without what a reader doesn't see.

    Comments, scripts and styles go, and so do elements without any letter or digit in them and hidden ones, with all
    inside; other tags lose layout attributes. Closing tags that match nothing go, missing ones are added where their
    elements end. ``place`` orders a page's rows.
    """
    # pinned: both are read several times, and taking pages apart is dear
    rows = pin_columns(page_rows(pages, key, html))
    found = elements(rows, key)
    empty = (F.col("texts") == 0) & ~F.col("name").isin(*KEPT_EMPTY)
    found = pin_columns(found.select(key, "start", "stop", "closed", "name", (empty | hidden(F.col("token"))).alias("out")))
    out = found.where("out")
    # an element covers its closing tag, if it has one
    after = F.col("stop") + F.col("closed").cast("int")
    events = out.select(key, F.col("start").alias("pos"), F.lit(1).alias("delta")).unionByName(out.select(key, after.alias("pos"), F.lit(-1).alias("delta")))
    added = found.where("NOT closed AND NOT out").select(
        key, F.col("stop").alias("pos"), F.struct(F.col("stop").alias("pos"), F.lit(0).alias("own"), (-F.col("start")).alias("back")).alias("place"),
        F.concat(F.lit("</"), "name", F.lit(">")).alias("token"), F.lit("close").alias("kind"), "name", F.lit(False).alias("stray"),
    )
    own = rows.join(found.where("closed").select(key, F.col("stop").alias("pos"), F.lit(True).alias("known")).distinct(), [key, "pos"], "left")
    own = own.select(
        key, "pos", F.struct("pos", F.lit(1).alias("own"), F.lit(0).alias("back")).alias("place"), "token", "kind", "name",
        ((F.col("kind") == "close") & F.col("known").isNull()).alias("stray"),
    )
    every = own.unionByName(added).withColumn("delta", F.lit(0)).unionByName(events, allowMissingColumns=True)
    covered = F.sum("delta").over(W.partitionBy(key).orderBy("pos"))
    every = every.withColumn("covered", covered).withColumn("any", F.max((F.col("kind") == "text") & F.col("token").rlike(LETTER)).over(W.partitionBy(key)))
    kept = every.where("place IS NOT NULL AND any AND covered = 0 AND kind <> 'gone' AND NOT stray")
    token = F.when(F.col("kind").isin("open", "void"), bare_tag(F.col("token"))).otherwise(F.col("token"))
    return kept.select(key, "place", token.alias("token"), "kind", "name")


def clean_pages(pages: DataFrame, key: str, html: str, name: str = "clean") -> DataFrame:
    """(key, ``name``): every page without what a reader doesn't see; a page without any text is empty, null stays null."""
    rows = cleaned_rows(pages, key, html)
    joined = rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), "").alias(name))
    return pages.select(key, F.col(html).alias("_page")).join(joined, key, "left").select(key, F.when(F.col("_page").isNotNull(), F.coalesce(name, F.lit(""))).alias(name))
