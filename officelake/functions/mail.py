"""Mail as columns: raw messages to headers, parts and main body, and encoded header words, all by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from officelake.functions import html

BLANK_LINE = r"\r?\n\r?\n"
ENCODED_WORD = r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?="


def header_fields(head: Column) -> Column:
    """array<struct<name, value>> of a header block; folded lines are joined."""
    lines = F.split(F.regexp_replace(head, r"\r?\n[ \t]+", " "), r"\r?\n")
    fields = F.filter(lines, lambda x: F.contains(x, F.lit(":")))
    return F.transform(
        fields, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.regexp_replace(x, r"^[^:]*:\s*|\s+$", "").alias("value"))
    )


def field(head: Column, name: str) -> Column:
    """The value of one header of a block, '' without it."""
    return F.regexp_extract(F.regexp_replace(head, r"\r?\n[ \t]+", " "), rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def percent_decoded(text: Column) -> Column:
    """Text whose bytes were written =XX."""
    safe = F.regexp_replace(F.regexp_replace(text, "%", "%25"), r"\+", "%2B")
    return F.try_url_decode(F.regexp_replace(safe, r"=([0-9A-Fa-f]{2})", "%$1"))


def transferred(content: Column, encoding: Column) -> Column:
    """A part's text as its transfer encoding has it (UTF-8)."""
    quoted = percent_decoded(F.regexp_replace(content, r"=\r?\n", ""))
    packed = F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8")
    return F.when(encoding == "base64", packed).when(encoding == "quoted-printable", quoted).otherwise(content)


def message_parts(text: Column) -> Column:
    """array<struct<mime_type, attached, content>>: every part that isn't a container, whatever its depth.

    All boundaries a message names are looked for at once, so nesting needs no recursion.
    """
    bounds = F.regexp_extract_all(text, F.lit(r"""(?i)boundary\s*=\s*"?([^"\s;]+)"""), F.lit(1))
    marks = F.array_join(F.transform(bounds, lambda b: F.concat(F.lit(r"\Q--"), b, F.lit(r"\E(?:--)?[ \t]*\r?\n?"))), "|")
    chunks = F.when(F.size(bounds) > 0, F.slice(F.split(text, marks, -1), 2, 1 << 30)).otherwise(F.array(text))

    def part(chunk: Column) -> Column:
        halves = F.split(chunk, BLANK_LINE, 2)
        head, body = halves[0], F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        kind = F.lower(F.trim(F.substring_index(field(head, "content-type"), ";", 1)))
        content = transferred(body, F.lower(F.trim(field(head, "content-transfer-encoding"))))
        return F.struct(
            F.when(kind == "", "text/plain").otherwise(kind).alias("mime_type"),
            F.lower(field(head, "content-disposition")).startswith("attachment").alias("attached"),
            content.alias("content"),
        )

    return F.filter(F.transform(chunks, part), lambda p: ~p["mime_type"].startswith("multipart/") & (p["content"] != ""))


def parse_mail(raw: Column) -> Column:
    """struct<headers, body_type, body, error> of raw mail bytes: the first html part that is no attachment, else the
    first plain one; no such part is an error unless the message has no content at all.
    """
    text = F.decode(raw, "UTF-8")
    parts = message_parts(text)
    of = lambda kind: F.get(F.filter(parts, lambda p: (p["mime_type"] == kind) & ~p["attached"]), F.lit(0))
    body = F.coalesce(of("text/html"), of("text/plain"))
    parsed = F.struct(
        header_fields(F.split(text, BLANK_LINE, 2)[0]).alias("headers"),
        body["mime_type"].alias("body_type"),
        F.when(F.size(parts) == 0, F.lit("")).otherwise(body["content"]).alias("body"),
        F.when((F.size(parts) > 0) & body.isNull(), "only attachments").alias("error"),
    )
    return F.when(raw.isNotNull(), parsed)


def mail_content(raw: Column, output: str = "raw") -> Column:
    """struct<value, error>: the main body as it is (``raw``), cleaned (``clean``) or as markdown (``md``)."""
    ways = {"raw": lambda c: c, "clean": html.clean, "md": html.to_markdown}
    if output not in ways:
        raise ValueError(f"unknown output {output!r}")
    parsed = parse_mail(raw)
    return F.struct(ways[output](parsed["body"]).alias("value"), parsed["error"].alias("error"))


def choose_body(parts: DataFrame, key: str = "id") -> DataFrame:
    """Main body from exploded parts: html if there is one, else the last plain part.

    A body that is an attachment is an error. An aggregate, so a mail of any size combines map-side.
    """
    kind = F.lower("mime_type")
    preference = F.when(kind == "text/html", 2).when(kind == "text/plain", 1)
    # Among html parts the first counts, among plain ones the last.
    place = F.when(kind == "text/html", -F.col("part_no")).otherwise(F.col("part_no"))
    usable = parts.where(preference.isNotNull())
    best = usable.groupBy(key).agg(
        F.max_by(F.struct("mime_type", "content", "is_attachment"), F.struct(preference, place)).alias("b")
    )
    bad = F.col("b.is_attachment")
    return best.select(
        key,
        F.when(~bad, F.col("b.mime_type")).alias("body_type"),
        F.when(~bad, F.col("b.content")).alias("body"),
        F.when(bad, "the body is an attachment").alias("error"),
    )


def decode_header(c: Column) -> Column:
    """Header text with encoded words (UTF-8; base64 words also Latin-1) in place; '' becomes null.

    White space between two encoded words belongs to neither.
    """
    tight = F.regexp_replace(c, r"\?=\s+=\?", "?==?")
    words = F.regexp_extract_all(tight, F.lit(ENCODED_WORD), F.lit(0))

    def word(w: Column) -> Column:
        charset, coding, content = (F.regexp_extract(w, ENCODED_WORD, g) for g in (1, 2, 3))
        packed = F.unbase64(content)
        plain = F.when(F.lower(charset) == "iso-8859-1", F.decode(packed, "ISO-8859-1")).otherwise(F.decode(packed, "UTF-8"))
        return F.when(F.lower(coding) == "b", plain).otherwise(percent_decoded(F.regexp_replace(content, "_", " ")))

    mixed = F.zip_with(F.split(tight, ENCODED_WORD, -1), F.transform(words, word), lambda p, w: F.concat(p, F.coalesce(w, F.lit(""))))
    return F.nullif(F.when(c.contains("=?"), F.array_join(mixed, "")).otherwise(c), F.lit(""))
