"""Calendar scans over event rows with ``start_us``/``end_us`` in microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HORIZON_DAYS = 90  # fixed value: how far a listing looks ahead when no end is given
_DAY_US = 86_400_000_000


def fetch_events(
    events: DataFrame,
    query: str | None = None,
    time_min: Column | None = None,
    time_max: Column | None = None,
    max_results: int | None = None,
    i_cal_uid: str | None = None,
    max_attendees: int | None = None,
    order: list[str] = ["start_us", "id"],
) -> DataFrame:
    """Events overlapping the open interval (time_min, time_max), by free text and calendar uid."""
    out = events
    if time_min is not None:
        out = out.where(F.col("end_us") > F.unix_micros(time_min))
    if time_max is not None:
        out = out.where(F.col("start_us") < F.unix_micros(time_max))
    if query:
        text = F.lower(F.concat_ws(" ", "summary", "description", "location"))
        out = out.where(text.contains(query.lower()))
    if i_cal_uid:
        out = out.where(F.col("iCalUID") == i_cal_uid)
    if max_attendees:
        out = out.withColumn("attendees", F.slice("attendees", 1, max_attendees))
    if max_results:
        out = out.orderBy(*order).limit(max_results)
    return out


def upcoming(events: DataFrame, reference: Column, days: int = HORIZON_DAYS) -> DataFrame:
    """Events from the reference time on, up to the default horizon."""
    until = F.timestamp_micros(F.unix_micros(reference) + days * _DAY_US)
    return fetch_events(events, time_min=reference, time_max=until)


INSTANCES = 10_000  # instances of one event made from one row


def single_events(events: DataFrame, rule: str = "recurrence") -> DataFrame:
    """Instances of recurring events (DAILY and WEEKLY with INTERVAL and COUNT or UNTIL).

    Events without a rule pass through as their own instance 0; rules this does not know, and rules without an end,
    give one row with ``error`` set. Instances are made in blocks, so that a long rule is never one list.
    """
    text = F.coalesce(F.col(rule), F.lit(""))

    def part(name: str, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"(?:^|[:;]){name}=({pattern})(?:;|$)", 1), F.lit(""))

    step = (
        F.when(part("FREQ", r"\w+") == "DAILY", F.lit(_DAY_US))
        .when(part("FREQ", r"\w+") == "WEEKLY", F.lit(7 * _DAY_US))
        .otherwise(F.lit(None).cast("long"))
    ) * F.coalesce(part("INTERVAL", r"\d{1,6}").cast("long"), F.lit(1))
    until_text = part("UNTIL", r"\d{8}T\d{6}Z")
    until = F.unix_micros(F.try_to_timestamp(until_text, F.lit("yyyyMMdd'T'HHmmss'Z'")))
    by_count = part("COUNT", r"\d{1,9}").cast("long")
    by_until = F.floor((until - F.col("start_us")) / step) + 1
    known = text.rlike(r"^RRULE:(?:(?:FREQ|INTERVAL|COUNT|UNTIL)=[^;]+;?)+$") & (step > 0)
    n = F.when(text == "", F.lit(1)).when(known, F.coalesce(by_count, by_until))
    ok = n.isNotNull()
    counted = events.withColumn("_step", F.coalesce(step, F.lit(0))).withColumn(
        "_n", F.when(ok, F.greatest(n, F.lit(0)))
    )
    zero = F.lit(0).cast("long")
    blocks = F.when(F.col("_n") > 0, F.sequence(zero, F.expr(f"(_n - 1) div {INSTANCES}"))).when(F.col("_n").isNull(), F.array(zero))
    first = F.col("_block") * INSTANCES
    places = F.when(F.col("_n").isNull(), F.array(zero)).otherwise(F.sequence(first, F.least(first + (INSTANCES - 1), F.col("_n") - 1)))
    out = counted.withColumn("_block", F.explode(blocks)).withColumn("instance", F.explode(places))
    return out.select(
        *[c for c in events.columns if c not in ("start_us", "end_us")],
        "instance",
        (F.col("start_us") + F.col("instance") * F.col("_step")).alias("start_us"),
        (F.col("end_us") + F.col("instance") * F.col("_step")).alias("end_us"),
        F.when(F.col("_n").isNull(), F.concat(F.lit("unsupported rule: "), F.col(rule))).alias("error"),
    )
