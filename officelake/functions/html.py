"""Web pages: cleaning and markdown as chains of built-in string functions, one table of steps for each."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

VALUE_OR_ERROR = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])

#: What a model has no use for; attributes that only lay out a page.
LAYOUT_ATTRIBUTES = "class|style|align|border|cellpadding|cellspacing|id|background|role|type|valign"
TAG = r"<[^<>]+>"
ATTRIBUTE = rf"""(?i)\s+(?:{LAYOUT_ATTRIBUTES})\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""

#: (pattern, replacement), in order; groups are written $1. Patterns keep to what any regex engine has.
CLEAN_STEPS = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    (r"[ \t\r\n\f]+", " "),
]
MARKDOWN_STEPS = [
    (r"(?is)<head\b[^>]*>.*?</head\s*>", ""),
    (r"(?i)<!doctype[^>]*>", ""),
    (r"(?is)<(?:b|strong)\b[^>]*>\s*([^<]*[^<\s])\s*</(?:b|strong)\s*>", "**$1**"),
    (r"(?is)<(?:i|em)\b[^>]*>\s*([^<]*[^<\s])\s*</(?:i|em)\s*>", "*$1*"),
    (r"(?is)<code\b[^>]*>([^<]*)</code\s*>", "`$1`"),
    (r"""(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>\s*([^<]*?)\s*</a\s*>""", "[$2]($1)"),
    (r"""(?is)<img\b[^>]*?\bsrc\s*=\s*"([^"]*)"[^>]*>""", "![]($1)"),
    *[(rf"(?i)<h{n}\b[^>]*>\s*", "\n\n" + "#" * n + " ") for n in range(1, 7)],
    (r"(?i)<li\b[^>]*>\s*", "\n* "),
    (r"(?i)<br\b[^>]*>\s*", "  \n"),
    (r"(?i)<hr\b[^>]*>\s*", "\n\n---\n\n"),
    (r"(?i)<blockquote\b[^>]*>\s*", "\n\n> "),
    (r"(?i)<tr\b[^>]*>\s*", "\n|"),
    (r"(?i)<t[dh]\b[^>]*>\s*", " "),
    (r"(?i)\s*</t[dh]\s*>", " |"),
    (r"(?i)</?(?:p|div|ul|ol|table|section|article|nav|header|footer|main|pre|blockquote|h[1-6])\b[^>]*>\s*", "\n\n"),
    (r"<[^<>]*>", ""),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
    (r"[ \t]+\n\n", "\n\n"),
    (r"\n\n[ \t]+", "\n\n"),
    (r"\n{3,}", "\n\n"),
    (r"^\s+|\s+$", ""),
]


def stepped(text: Column, steps: list[tuple[str, str]]) -> Column:
    """The text after all steps."""
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def sql_steps(text: str, steps: list[tuple[str, str]]) -> str:
    """The same steps as nested SQL calls."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, replacement in steps:
        back = replacement.replace("\\", r"\\").replace("$1", r"\1").replace("$2", r"\2")
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(back)}, 'g')"
    return text


def clean(html: Column) -> Column:
    """The page without comments, scripts, styles, layout attributes and runs of white space."""
    bare = stepped(html, CLEAN_STEPS)
    between = F.split(bare, TAG, -1)
    tags = F.transform(F.regexp_extract_all(bare, F.lit(TAG), F.lit(0)), lambda t: F.regexp_replace(t, ATTRIBUTE, ""))
    return F.array_join(F.zip_with(between, tags, lambda b, t: F.concat(b, F.coalesce(t, F.lit("")))), "")


def clean_sql(html: str) -> str:
    """``clean`` as SQL."""
    bare = sql_steps(html, CLEAN_STEPS)
    attribute = ATTRIBUTE.replace("'", "''")
    pieces = f"string_split_regex({bare}, '{TAG}')"
    tags = f"list_transform(regexp_extract_all({bare}, '{TAG}'), lambda t: regexp_replace(t, '{attribute}', '', 'g'))"
    return f"list_reduce(list_transform(list_zip({pieces}, {tags}), lambda z: z[1] || coalesce(z[2], '')), lambda a, b: a || b)"


def to_markdown(html: Column) -> Column:
    """Headings, emphasis, links, lists, tables and paragraphs of the page as markdown; all other markup is dropped."""
    return stepped(stepped(html, CLEAN_STEPS), MARKDOWN_STEPS)


def document_markdown(html: Column) -> Column:
    """struct<value, error>: the page as markdown; a page without any text is an error."""
    text = to_markdown(html)
    return F.struct(F.when(text != "", text).alias("value"), F.when(text == "", "the page has no text").alias("error"))


def convert(content: Column, source: Column, target: Column) -> Column:
    """struct<value, error>: content from one media type in another, where there is a way."""
    html, same = source == "text/html", source == target
    value = F.when(same, content).when(html & (target == "text/markdown"), to_markdown(content)).when(html & (target == "text/x-clean-html"), clean(content))
    known = same | (html & target.isin("text/markdown", "text/x-clean-html"))
    return F.struct(value.alias("value"), F.when(~known, F.concat(F.lit("no way from "), source, F.lit(" to "), target)).alias("error"))
