"""Date and time functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Offsets of the zone names mail dates use.
ZONES = {
    "GMT": "+0000",
    "UT": "+0000",
    "UTC": "+0000",
    "Z": "+0000",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}


def mail_date(c: Column) -> Column:
    """A mail header date as UTC ``…Z`` text in struct<value, error>.

    A date without a zone is taken as it is. The weekday is not looked at: it may contradict the date.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"^\s*[A-Za-z]+,\s*", ""))
    bare = F.regexp_replace(bare, r"\s+", " ")
    bare = F.regexp_replace(bare, r"^(\d+ \w+ \d+ \d+:\d+)( |$)", "$1:00$2")
    name = F.regexp_extract(bare, r" ([A-Z]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    offset = F.try_element_at(table, name)
    zoned = F.when(offset.isNotNull(), F.concat(F.regexp_replace(bare, r" [A-Z]+$", " "), offset)).otherwise(bare)
    aware = F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))
    naive = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss"))
    value = F.date_format(F.coalesce(aware, naive), ISO_Z)
    error = F.when(value.isNull(), F.concat(F.lit("unparsable date: "), F.coalesce(c, F.lit(""))))
    return F.struct(value.alias("value"), error.alias("error"))


def iso_utc(c: Column, zone: str = "UTC") -> Column:
    """Wall-clock time of ``zone`` as UTC ``…Z`` text to the second."""
    return F.date_format(F.to_utc_timestamp(c, zone), ISO_Z)


def micros(c: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(c.cast("timestamp"))


def earliest_valid(reference: Column, max_age_seconds: Column) -> Column:
    """The oldest time still valid; without a maximum age everything is (null)."""
    return F.timestamp_micros(F.unix_micros(reference) - (max_age_seconds.cast("double") * 1_000_000).cast("long"))


def still_valid(at: Column, reference: Column, max_age_seconds: Column) -> Column:
    """Whether a time is not older than the maximum age."""
    return F.coalesce(at >= earliest_valid(reference, max_age_seconds), F.lit(True))
