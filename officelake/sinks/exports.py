"""Export plans and listings. A plan is a table of paths; writing it is one more DataFrame write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from officelake.functions.strings import extension_from_mime
from officelake.operators.ordering import ordered_lists, ordinal
from officelake.sources.mailbox import path_exists

LIST_FIELDS = ["id", "name", "fileExtension", "mimeType", "description", "md5Checksum", "modifiedTime"]  # fixed


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with a digest of the rows as a set: md5 words summed, so no task sees all rows."""
    line = F.md5(F.to_json(F.struct(*columns)))
    words = [F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    return df.agg(
        F.count("*").alias("rows"), *[F.coalesce(F.sum(w), F.lit(0)).alias(f"word{i}") for i, w in enumerate(words)]
    )


def save_index(index: DataFrame, path: str, order: list[Column]) -> bool:
    """Write the index sorted, unless the saved one has the same content. Returns whether it wrote.

    The sort is by range over all tasks: read in file order the files give the whole order. The new index is written
    beside the saved one and then takes its place by two renames, so readers see one of them at (nearly) any time and
    never a part. One mark tells what is saved now; it is taken away before that, so a run that breaks off is repeated.
    """
    spark = index.sparkSession
    digest = str(tuple(content_digest(index, index.columns).first()))
    mark = f"{path}.digest"
    if path_exists(spark, mark) and path_exists(spark, path):
        current = spark.read.schema("digest string").json(mark).first()
        if current is not None and current["digest"] == digest:
            return False
    staged = f"{path}.{uuid.uuid4().hex}"
    index.orderBy(*order).write.json(staged)
    spark.createDataFrame([("none",)], "digest string").write.mode("overwrite").json(mark)
    put_in_place(spark, staged, path)
    spark.createDataFrame([(digest,)], "digest string").write.mode("overwrite").json(mark)
    return True


def put_in_place(spark: SparkSession, staged: str, path: str) -> None:
    """Let a written folder take the place of another, which goes."""
    new, target, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path, f"{staged}.old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(new, target):
        raise OSError(f"{staged} can't become {path}")
    fs.delete(old, True)


def mail_export_plan(
    messages: DataFrame,
    existing: DataFrame | None = None,
    indexed: DataFrame | None = None,
    as_markdown: bool = False,
    by_thread: bool = True,
    force: bool = False,
) -> DataFrame:
    """Messages to write with their path and metadata text.

    A message is skipped when its file exists and, if an index is kept, it is indexed too.
    """
    ext = ".md" if as_markdown else ".msg"
    name = F.concat("id", F.lit(ext))
    folder = F.when(F.coalesce("thread_id", F.lit("")) != "", F.concat("thread_id", F.lit("/"))).otherwise("")
    plan = messages.withColumn("path", F.concat(folder, name) if by_thread else name)
    if not force and existing is not None:
        skip = plan.select("id", "path").join(existing.select("path"), "path", "left_semi")
        if indexed is not None:
            skip = skip.join(indexed.select("id"), "id", "left_semi")
        plan = plan.join(skip.select("id"), "id", "left_anti")
    return plan


def write_messages(plan: DataFrame, root: str, content: str = "body", files: int = 0) -> None:
    """Write planned messages as a parquet table sorted by path (``files`` > 0 fixes the number of tasks)."""
    out = plan.select("path", F.col(content).alias("content"))
    out = out.repartitionByRange(files, "path") if files else out.repartitionByRange("path")
    out.sortWithinPartitions("path").write.mode("append").parquet(root)


def drive_export_plan(
    found: DataFrame, existing: DataFrame | None = None, as_markdown: bool = False, force: bool = False
) -> DataFrame:
    """Files to download with their output path; a file without a name is stored under its id."""
    path = F.coalesce("name", F.col("id").cast("string"))
    if as_markdown:
        path = F.concat(F.regexp_replace(path, r"(?s)(?<=[^/.])\.[^./]*$", ""), F.lit(".md"))
    plan = found.withColumn("path", path)
    if existing is not None and not force:
        plan = plan.join(existing.select("path"), "path", "left_anti")
    return plan


def drive_listing(files: DataFrame) -> DataFrame:
    """The fixed columns of a listing, '' for what is missing, the extension derived from the media type."""
    ext = F.when(F.coalesce("fileExtension", F.lit("")) == "", extension_from_mime(F.col("mimeType"))).otherwise(
        F.col("fileExtension")
    )
    values = {c: F.col(c).cast("string") for c in LIST_FIELDS} | {"fileExtension": ext}
    return files.select(*[F.coalesce(values[c], F.lit("")).alias(c) for c in LIST_FIELDS])


def write_listing(listing: DataFrame, path: str, delimiter: str = "\t", as_json: bool = False) -> None:
    """Write a listing as delimited text with a header, or as JSON."""
    if as_json:
        listing.write.json(path)
    else:
        listing.write.csv(path, sep=delimiter, header=True, emptyValue="")


def calendar_listing(events: DataFrame, all_day: bool = False) -> DataFrame:
    """id, summary, start, end, location; all-day events only show their dates with ``all_day``."""

    def at(side: str) -> Column:
        return F.coalesce(f"{side}.dateTime", f"{side}.date") if all_day else F.col(f"{side}.dateTime")

    return events.select("id", "summary", at("start").alias("start"), at("end").alias("end"), "location")


def task_lines(tasks: DataFrame) -> DataFrame:
    """Tab-separated id, title, status and external URL."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "title", "status", "id_url")]
    return tasks.select(F.concat_ws("\t", *shown).alias("line"))


def digest(items: DataFrame, category: str, order: list[Column], line: Column) -> DataFrame:
    """A summary per category: how many items, and their lines in order."""
    lines = ordered_lists(items, [category], order, line, "lines")
    return lines.select(category, F.size("lines").cast("long").alias("items"), F.array_join("lines", "\n").alias("summary"))


def digest_lines(items: DataFrame, category: str, order: list[Column], line: Column) -> DataFrame:
    """The lines of a summary per category, one row each: category, position in it from 0, how many it has, and the line.

    No category is ever one value or one task: positions come from a range sort, and counts combine map-side.
    """
    placed = ordinal(items.withColumn("line", line), [category], order, "position")
    counts = items.groupBy(F.col(category).alias("_of")).agg(F.count(F.lit(1)).alias("items"))
    return placed.join(counts, F.col(category).eqNullSafe(F.col("_of"))).select(category, "position", "items", "line")


def write_digest(lines: DataFrame, category: str, path: str) -> None:
    """Write the summaries as text, a folder per category, whose files read in order are its lines in order."""
    out = lines.repartitionByRange(category, "position").sortWithinPartitions(category, "position")
    out.select(category, F.col("line").alias("value")).write.partitionBy(category).text(path)
