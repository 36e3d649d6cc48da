"""File and drive scans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from officelake.functions.strings import glob_to_regex, mime_from_name


@F.pandas_udf(T.StringType())
def _decode_dropping(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def decode_utf8(content):
    """Text of UTF-8 bytes, dropping invalid bytes; only rows that have such bytes go through Python."""
    plain = F.try_validate_utf8(content.cast("string"))
    broken = _decode_dropping(F.when(plain.isNull(), content))
    return F.coalesce(plain, broken)


def list_files(files: DataFrame, predicate=None) -> DataFrame:
    """File metadata in the fixed projection of a drive listing."""
    out = files if predicate is None else files.where(predicate)
    return out.select("id", "name", "mimeType", "modifiedTime", "md5Checksum", "fileExtension")


def unique_by_name(files: DataFrame) -> DataFrame:
    """Per name the number of files and the file id, given only when exactly one file has the name."""
    counted = files.groupBy("name").agg(F.count("*").alias("matches"), F.min("id").alias("_id"))
    return counted.select("name", "matches", F.when(F.col("matches") == 1, F.col("_id")).alias("id"))


def get_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve requests by ``file_id``, else by a ``filename`` that is unique; no match leaves ``id`` null."""
    by_id = files.select(F.col("id").alias("file_id"), F.col("id").alias("_by_id"))
    by_name = unique_by_name(files).select(F.col("name").alias("filename"), F.col("id").alias("_by_name"))
    joined = requests.join(by_id, "file_id", "left").join(by_name, "filename", "left")
    found = F.when(F.col("file_id").isNotNull(), F.col("_by_id")).otherwise(F.col("_by_name"))
    return joined.select(*requests.columns, found.alias("id"))


def containers(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Files under a path with content, modification time and media type; unused content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select(
        "path",
        F.unix_micros("modificationTime").alias("modified_us"),
        "length",
        mime_from_name(F.col("path")).alias("mime_type"),
        "content",
    )


def expand_typed(files: DataFrame) -> DataFrame:
    """Content parsed by file extension: ``json`` to a variant, ``txt`` to text, mail to its main body.

    Unknown extensions are read as text with a warning.
    """
    from officelake.functions.mail import mail_content

    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = decode_utf8(F.col("content"))
    is_mail = ext.isin("email", "eml")
    parsed = F.try_parse_json(F.when(ext == "json", text))
    message = mail_content(F.when(is_mail, F.col("content")), "raw")
    return files.select(
        "path",
        F.when(ext == "json", "json").when(is_mail, "email").otherwise("text").alias("kind"),
        parsed.alias("json"),
        F.when(is_mail, message["value"]).when(ext != "json", text).alias("text"),
        F.when((ext == "json") & parsed.isNull(), "invalid JSON")
        .when(is_mail, message["error"])
        .alias("error"),
        F.when(~ext.isin("json", "txt", "email", "eml"), F.concat(F.lit("unknown type read as text: "), ext)).alias(
            "warning"
        ),
    )


def glob_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose path matches a glob."""
    return df.where(F.col(column).rlike(glob_to_regex(pattern)))
