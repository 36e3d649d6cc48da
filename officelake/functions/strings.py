"""String functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LINK_MARK = "\U0001f517"  # fixed value: a note line that starts with it carries the external URL


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 code units, the unit of document offsets."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def message_id(c: Column) -> Column:
    """The id without its surrounding angle brackets."""
    return F.regexp_replace(c, r"^<(.*)>$", "$1")


def from_base64url(c: Column) -> Column:
    """Bytes of base64url text."""
    return F.unbase64(F.translate(c, "-_", "+/"))


def truncate_prompt(c: Column, limit: int = 20000) -> Column:
    """A prompt part cut to what a model call accepts."""
    return F.substring(c, 1, limit)


def escape_link(c: Column) -> Column:
    """A URL with its spaces escaped."""
    return F.replace(c, F.lit(" "), F.lit("%20"))


def priority_symbol(priority: Column) -> Column:
    """The symbol shown before a to-do of that priority."""
    level = F.lower(priority)
    return (
        F.when(level == "critical", "\U0001f198")
        .when(level == "high", "\U0001f534")
        .when(level == "medium", "\U0001f535")
        .otherwise("⚪")
    )


def _note_lines(notes: Column) -> Column:
    return F.split(F.coalesce(notes, F.lit("")), "\r\n|\r|\n")


def get_id_url(notes: Column) -> Column:
    """The external URL kept in the first marked line of the notes, or null."""
    marked = F.filter(_note_lines(notes), lambda x: x.startswith(LINK_MARK))
    return F.trim(F.substring(F.try_element_at(marked, F.lit(1)), 2, 1 << 30))


def set_id_url(notes: Column, id_url: Column) -> Column:
    """Notes with ``id_url`` as the marked first line and every other marked line removed."""
    kept = F.filter(_note_lines(notes), lambda x: ~x.startswith(LINK_MARK))
    kept = F.when(F.coalesce(notes, F.lit("")) == "", F.array().cast("array<string>")).otherwise(kept)
    return F.array_join(F.concat(F.array(F.concat(F.lit(LINK_MARK), id_url)), kept), "\n")


def split_modification_id(c: Column) -> Column:
    """``analysis|number`` into a placement key; null when the id is empty or the number is not one."""
    head = F.regexp_extract(c, r"(?s)^(.+)\|([^|]*)$", 1)
    number = F.regexp_extract(c, r"(?s)^(.+)\|([^|]*)$", 2).try_cast("int")
    return F.when(
        (head != "") & number.isNotNull(),
        F.struct(head.alias("analysis_id"), number.alias("action_number"), F.lit("(None)").alias("placement_id")),
    )


def parse_assignments(c: Column, separator: str = "&") -> Column:
    """``k=v`` pairs as a map; names are word characters, the last of equal names wins."""
    pairs = F.filter(F.split(c, separator), lambda p: p.rlike(r"(?s)^\w+=.*$"))
    entries = F.transform(
        pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, r"(?s)^\w+=", "").alias("v"))
    )
    last = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))),
        lambda e: ~F.exists(F.slice(entries, e["i"] + 2, F.size(entries)), lambda o: o["k"] == e["k"]),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def typed_assignments(c: Column, fields: dict[str, str], ignore_unknown: bool = False) -> Column:
    """Assignments cast to ``fields`` (name -> type), as struct<value, error>."""
    found = parse_assignments(c)
    value = F.struct(*[F.try_element_at(found, F.lit(n)).try_cast(t).alias(n) for n, t in fields.items()])
    unknown = F.array_sort(F.array_except(F.map_keys(found), F.array(*[F.lit(n) for n in fields])))
    bad = F.filter(
        F.array(
            *[
                F.when(
                    F.try_element_at(found, F.lit(n)).isNotNull()
                    & F.try_element_at(found, F.lit(n)).try_cast(t).isNull(),
                    F.lit(n),
                )
                for n, t in fields.items()
            ]
        ),
        lambda x: x.isNotNull(),
    )
    error = F.when((F.size(bad) > 0), F.concat(F.lit("not of type: "), F.array_join(bad, ",")))
    if not ignore_unknown:
        error = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ","))).otherwise(error)
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


# Media types by file extension.
MIME_BY_EXTENSION = {
    "txt": "text/plain",
    "md": "text/markdown",
    "html": "text/html",
    "htm": "text/html",
    "csv": "text/csv",
    "css": "text/css",
    "js": "text/javascript",
    "json": "application/json",
    "xml": "text/xml",
    "pdf": "application/pdf",
    "zip": "application/zip",
    "eml": "message/rfc822",
    "jpg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "mp3": "audio/mpeg",
    "mp4": "video/mp4",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


def _map_literal(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def mime_from_name(name: Column) -> Column:
    """Media type by the extension of a file name, or null."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.try_element_at(_map_literal(MIME_BY_EXTENSION), extension)


def extension_from_mime(mime: Column, overrides: dict[str, str] | None = None) -> Column:
    """File extension (with its dot) of a media type, '' when unknown."""
    first: dict[str, str] = {}
    for ext, kind in MIME_BY_EXTENSION.items():
        first.setdefault(kind, "." + ext)
    first.update(overrides or {})
    return F.coalesce(F.try_element_at(_map_literal(first), mime), F.lit(""))


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for a path glob (``**`` any depth, ``*`` one segment, ``?`` one char)."""
    import re

    meaning = {"**": "(?:.*?)?", "*": "[^/]*", "?": "."}
    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return "^" + "".join(meaning.get(p, re.escape(p)) for p in parts) + "$"
