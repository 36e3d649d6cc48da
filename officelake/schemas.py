"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


MAIL_MESSAGE = T.StructType(
    _strings("id", "threadId", "snippet", "historyId", "internalDate")
    + [T.StructField("sizeEstimate", T.IntegerType())]
    + _strings("raw")
)

MAIL_INDEX = T.StructType(
    _strings("id", "path", "subject", "received_date", "snippet", "senders", "recipients", "cc", "bcc")
)

MAIL_METADATA = T.StructType(MAIL_INDEX.fields + _strings("mail_data_id"))

SOURCE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created_time", T.TimestampType()),
        T.StructField("type", T.StringType()),
    ]
)

MAIL_SOURCE = T.StructType(_strings("id", "mail_metadata_id"))

LINKS = T.ArrayType(T.StructType(_strings("title", "url")))

ACTION_ITEM = T.StructType(
    [
        T.StructField("analysis_id", T.StringType()),
        T.StructField("action_number", T.IntegerType()),
        *_strings("title", "notes", "priority", "due_date"),
        T.StructField("links", LINKS),
        T.StructField("source_url", T.StringType()),
    ]
)

ANALYSIS = T.StructType(
    [
        *_strings("id", "category"),
        T.StructField("noteworthy_details", T.ArrayType(T.StringType())),
        T.StructField("people", T.ArrayType(T.StructType(_strings("name", "role")))),
        T.StructField("identifiers", T.ArrayType(T.StructType(_strings("name", "value")))),
    ]
)

PLACEMENT = T.StructType(
    [
        T.StructField("analysis_id", T.StringType()),
        T.StructField("action_number", T.IntegerType()),
        *_strings("placement_container_url", "placement_id"),
    ]
)

TASK = T.StructType(
    [
        *_strings("id", "tasklist_id", "title", "status", "notes", "due", "parent", "etag", "selfLink", "id_url"),
        T.StructField("position", T.IntegerType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("hidden", T.BooleanType()),
    ]
)

MANAGED_TASK = T.StructType(_strings("id_url", "tasklist_id", "title", "notes", "status", "due"))

DRIVE_FILE = T.StructType(
    _strings("id", "name", "fileExtension", "mimeType", "description", "md5Checksum", "modifiedTime")
)

CELL_VALUE = T.StructType(
    [
        T.StructField("numberValue", T.DoubleType()),
        T.StructField("stringValue", T.StringType()),
        T.StructField("boolValue", T.BooleanType()),
        T.StructField("formulaValue", T.StringType()),
        T.StructField("errorValue", T.StructType(_strings("type", "message"))),
    ]
)

_GRID = T.StructType(
    [
        T.StructField("startRow", T.IntegerType()),
        T.StructField("startColumn", T.IntegerType()),
        T.StructField(
            "rowData",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "values", T.ArrayType(T.StructType([T.StructField("effectiveValue", CELL_VALUE)]))
                        )
                    ]
                )
            ),
        ),
    ]
)

SPREADSHEET = T.StructType(
    [
        T.StructField("spreadsheetId", T.StringType()),
        T.StructField("sheets", T.ArrayType(T.StructType([T.StructField("data", T.ArrayType(_GRID))]))),
    ]
)

CACHED_CALL = T.StructType(
    [
        *_strings("reg_key", "args_hash", "serialized_args", "value"),
        T.StructField("added", T.TimestampType()),
        T.StructField("accessed", T.TimestampType()),
    ]
)

BUS_MESSAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *_strings("topic", "message", "sender"),
        T.StructField("ts", T.TimestampType()),
    ]
)

BUS_CURSOR = T.StructType([*_strings("agent", "topic"), T.StructField("offset", T.LongType())])

RULE = T.StructType(_strings("label", "predicate", "description"))
