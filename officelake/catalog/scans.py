"""Bindings: sources and scans."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from officelake.catalog import query
from officelake.plans import inputs
from officelake.plans.inputs import CALENDAR_SQL, ELEMENTS_SQL, MAIL_SQL, TASKS_SQL, table
from officelake.schemas import MAIL_INDEX
from officelake.session import work_dir
from officelake.sources import calendar, documents, files, mailbox, sheets, tables, tasks

def _newest_first():
    return [F.col("received_date").desc(), F.col("id").asc()]


@query(
    "s1_fetch_ids",
    f"WITH {MAIL_SQL} SELECT id, thread_id FROM mail WHERE role = 'user' ORDER BY received_date DESC, id LIMIT 500",
)
def s1(spark, sf):
    return mailbox.fetch_ids(inputs.mail(spark, sf), F.col("role") == "user", _newest_first())


@query("s2_generate_ids", f"WITH {MAIL_SQL} SELECT id, thread_id FROM mail WHERE role <> 'system'")
def s2(spark, sf):
    return mailbox.generate_ids(inputs.mail(spark, sf), F.col("role") != "system")


@query(
    "s3_search_expand",
    f"""WITH {MAIL_SQL}, ids AS (
        SELECT id FROM mail WHERE contains(body, 'the'))
        SELECT m.id, m.senders, m.subject, m.received_date, m.body FROM ids JOIN mail m ON m.id = ids.id""",
)
def s3(spark, sf):
    mail = inputs.mail(spark, sf)
    ids = mailbox.generate_ids(mail, F.col("body").contains("the"))
    return mailbox.search_expand(ids, mail.select("id", "senders", "subject", "received_date", "body"))


@query(
    "s4_download_message",
    f"""WITH {MAIL_SQL}, ids AS (SELECT conv_id || '-' || (turn + 1) AS id FROM conversations)
        SELECT ids.id, m.body, CASE WHEN m.id IS NULL THEN 'not found: ' || ids.id END AS error
        FROM ids LEFT JOIN mail m ON m.id = ids.id""",
)
def s4(spark, sf):
    ids = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("id"))
    out = mailbox.download(ids, inputs.mail(spark, sf).select("id", "body"))
    return out.select("id", "value.body", "error")


@query(
    "s5_fetch_events",
    f"""WITH {CALENDAR_SQL}
        SELECT id, summary, start_us, end_us, attendees[1] AS attendee FROM calendar
        WHERE end_us > epoch_us(TIMESTAMP '2024-01-05') AND start_us < epoch_us(TIMESTAMP '2024-01-25')
          AND contains(lower(summary || ' ' || description || ' ' || location), 'click')""",
)
def s5(spark, sf):
    out = calendar.fetch_events(
        inputs.calendar(spark, sf),
        query="Click",
        time_min=F.lit("2024-01-05").cast("timestamp"),
        time_max=F.lit("2024-01-25").cast("timestamp"),
        max_attendees=1,
    )
    return out.select("id", "summary", "start_us", "end_us", F.array_join("attendees", ",").alias("attendee"))


@query(
    "s6_upcoming_events",
    f"""WITH {CALENDAR_SQL} SELECT id, start_us FROM calendar
        WHERE end_us > epoch_us(TIMESTAMP '2024-01-12 06:00:00')
          AND start_us < epoch_us(TIMESTAMP '2024-01-12 06:00:00' + INTERVAL 90 DAYS)""",
)
def s6(spark, sf):
    reference = F.lit("2024-01-12 06:00:00").cast("timestamp")
    return calendar.upcoming(inputs.calendar(spark, sf), reference).select("id", "start_us")


def _recurring(spark, sf):
    k = F.get_json_object("description", "$.k").cast("int")
    daily = F.concat(F.lit("RRULE:FREQ=DAILY;INTERVAL="), 1 + k % 3, F.lit(";COUNT="), 1 + k % 5)
    rule = (
        F.when(F.col("summary") == "click", daily)
        .when(F.col("summary") == "view", "RRULE:FREQ=WEEKLY;UNTIL=20240201T000000Z")
        .when(F.col("summary") == "error", "RRULE:FREQ=MONTHLY;COUNT=2")
    )
    return inputs.calendar(spark, sf).withColumn("recurrence", rule)


@query(
    "s7_single_events",
    f"""WITH {CALENDAR_SQL}, r AS (
          SELECT *, CAST(json_extract_string(description, '$.k') AS INT) AS k FROM calendar),
        p AS (SELECT *,
            CASE summary WHEN 'click' THEN (1 + k % 3) * 86400000000 WHEN 'view' THEN 7 * 86400000000 ELSE 0 END AS step,
            CASE summary WHEN 'click' THEN 1 + k % 5
                 WHEN 'view' THEN (epoch_us(TIMESTAMP '2024-02-01') - start_us) // (7 * 86400000000) + 1
                 ELSE 1 END AS n FROM r)
        SELECT id, CAST(i AS BIGINT) AS instance, start_us + i * step AS start_us, end_us + i * step AS end_us,
               CASE WHEN summary = 'error' THEN 'unsupported rule: RRULE:FREQ=MONTHLY;COUNT=2' END AS error
        FROM (SELECT *, unnest(range(n)) AS i FROM p)""",
)
def s7(spark, sf):
    return calendar.single_events(_recurring(spark, sf)).select("id", "instance", "start_us", "end_us", "error")


@query("s8_generate_lists", "SELECT c_custkey AS id, c_name AS title FROM customer")
def s8(spark, sf):
    return tasks.generate_lists(_lists(spark, sf))


def _lists(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))


@query(
    "s9_generate_tasks",
    f"""WITH {TASKS_SQL} SELECT t.id, t.tasklist_id, t.title, t.status FROM tasks t
        JOIN customer c ON c.c_custkey = t.tasklist_id
        WHERE status <> 'completed' AND NOT coalesce(deleted, false) AND NOT coalesce(hidden, false)""",
)
def s9(spark, sf):
    out = tasks.generate_tasks(inputs.tasks(spark, sf), _lists(spark, sf))
    return out.select("id", "tasklist_id", "title", "status")


@query(
    "s10_get_task",
    f"""WITH {TASKS_SQL}, req AS (SELECT DISTINCT l_suppkey AS tasklist_id, l_orderkey AS id FROM lineitem)
        SELECT r.tasklist_id, r.id, t.title,
               CASE WHEN t.id IS NULL THEN 'task not found: ' || r.tasklist_id || '/' || r.id END AS error
        FROM req r LEFT JOIN tasks t ON t.id = r.id AND t.tasklist_id = r.tasklist_id""",
)
def s10(spark, sf):
    requests = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("tasklist_id"), F.col("l_orderkey").alias("id")
    ).distinct()
    return tasks.get_tasks(requests, inputs.tasks(spark, sf)).select("tasklist_id", "id", "title", "error")


def _drive(spark, sf):
    d = table(spark, sf, "documents")
    mime = F.when(F.col("lang") == "en", "text/html").when(F.col("lang") == "fr", "text/plain").when(
        F.col("lang") == "de", "application/pdf"
    )
    return d.select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("name"),
        mime.alias("mimeType"),
        F.lit(None).cast("string").alias("modifiedTime"),
        F.md5("text").alias("md5Checksum"),
        F.lit(None).cast("string").alias("fileExtension"),
        F.col("source").alias("description"),
    )


DRIVE_SQL = """drive AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS name,
         CASE lang WHEN 'en' THEN 'text/html' WHEN 'fr' THEN 'text/plain' WHEN 'de' THEN 'application/pdf' END AS mimeType,
         CAST(NULL AS VARCHAR) AS modifiedTime, md5(text) AS md5Checksum, CAST(NULL AS VARCHAR) AS fileExtension,
         source AS description
  FROM documents)"""


@query(
    "s11_list_files",
    f"WITH {DRIVE_SQL} SELECT id, name, mimeType, md5Checksum FROM drive WHERE description <> 'src1'",
)
def s11(spark, sf):
    out = files.list_files(_drive(spark, sf).where(F.col("description") != "src1"))
    return out.select("id", "name", "mimeType", "md5Checksum")


@query(
    "s12_get_file",
    f"""WITH {DRIVE_SQL}, n AS (SELECT name, count(*) AS c, min(id) AS id FROM drive GROUP BY name),
        req AS (SELECT CASE WHEN lang = 'en' THEN doc_id END AS file_id,
                       split_part(text, chr(10), 1) AS filename, doc_id AS request FROM documents)
        SELECT r.request, coalesce(r.file_id, CASE WHEN n.c = 1 THEN n.id END) AS id
        FROM req r LEFT JOIN n ON n.name = r.filename""",
)
def s12(spark, sf):
    d = table(spark, sf, "documents")
    requests = d.select(
        F.when(F.col("lang") == "en", F.col("doc_id")).alias("file_id"),
        F.substring_index("text", "\n", 1).alias("filename"),
        F.col("doc_id").alias("request"),
    )
    return files.get_files(requests, _drive(spark, sf)).select("request", "id")


@query("s13_get_doc_utf8", "SELECT doc_id, md5(text) AS digest, length(text) AS n_chars FROM documents")
def s13(spark, sf):
    # A stray byte in front of some documents, which decoding has to drop again.
    raw = F.encode("text", "UTF-8")
    content = F.when(F.col("lang") == "fr", F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw)
    text = table(spark, sf, "documents").select("doc_id", files.decode_utf8(content).alias("t"))
    return text.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query("s14_containers")
def s14(spark, sf):
    found = files.containers(spark, sf, glob="*.parquet")
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "mime_type", "length", (F.col("modified_us") > 0).alias("dated")
    )


@query(
    "s14_written_containers",
    """SELECT role, 'text/plain' AS mime_type, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) - length(replace(text, 'e', ''))) AS BIGINT) AS letters, true AS dated
       FROM conversations GROUP BY role""",
)
def s14_written(spark, sf):
    """Messages written as text files, a folder per role, and read as containers: sizes, types, times and content."""
    from officelake.session import work_dir

    root = work_dir(spark, "containers")
    table(spark, sf, "conversations").select("role", F.col("text").alias("value")).write.partitionBy("role").text(root)
    found = files.containers(spark, root, glob="*.txt")
    role = F.regexp_extract("path", "role=([^/]*)/", 1)
    text = F.decode("content", "UTF-8")
    letters = F.length(text) - F.length(F.replace(text, F.lit("e"), F.lit("")))
    return found.groupBy(role.alias("role"), "mime_type").agg(
        F.sum("length").alias("bytes"), F.sum(letters).cast("long").alias("letters"), F.min(F.col("modified_us") > 0).alias("dated")
    )


def _book(spark, sf):
    """A spreadsheet per document: a grid row per line, a cell per word."""
    line_cells = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.transform(
                F.split(line, " "),
                lambda w: F.struct(F.struct(F.when(w != "", w).alias("stringValue")).alias("effectiveValue")),
            ).alias("values")
        ),
    )
    grid = F.struct(F.lit(3).alias("startRow"), line_cells.alias("rowData"))
    sheet = F.array(F.struct(F.array(grid).alias("data")))
    d = inputs.texts(spark, sf, "documents")
    return d.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("spreadsheetId"), sheet.alias("sheets"))).alias("json"))


@query(
    "s15_get_sheet",
    """WITH l AS (SELECT doc_id, CAST(i + 3 AS BIGINT) AS row_num, string_split(string_split(text, chr(10))[i + 1], ' ') AS words
                  FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))
       SELECT doc_id, row_num, CAST(count(*) AS BIGINT) AS cells, min(nullif(w, '')) AS first_value
       FROM (SELECT doc_id, row_num, unnest(words) AS w FROM l) GROUP BY doc_id, row_num""",
)
def s15(spark, sf):
    cells = sheets.grid_cells(sheets.parse_spreadsheets(_book(spark, sf), "json"))
    return cells.groupBy("doc_id", F.col("row_num").cast("long").alias("row_num")).agg(
        F.count("*").alias("cells"), F.min("cell.stringValue").alias("first_value")
    )


@query(
    "s16_get_document",
    f"""WITH {ELEMENTS_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pos AS BIGINT) AS pos, start_index, end_index,
        level, heading_id, text FROM elements""",
)
def s16(spark, sf):
    from officelake.operators.ordering import ordered_lists

    e = inputs.elements(spark, sf)
    item = F.struct(
        F.col("start_index").alias("startIndex"),
        F.col("end_index").alias("endIndex"),
        F.struct(
            F.array(F.struct(F.col("start_index").alias("startIndex"), F.col("end_index").alias("endIndex"), F.struct(F.col("text").alias("content")).alias("textRun"))).alias("elements"),
            F.struct(F.col("level").alias("namedStyleType"), F.col("heading_id").alias("headingId")).alias("paragraphStyle"),
        ).alias("paragraph"),
    )
    docs = ordered_lists(e, ["doc_id"], [F.col("pos")], item, "content")
    json = docs.select(
        F.to_json(
            F.struct(F.col("doc_id").cast("string").alias("documentId"), F.struct("content").alias("body"))
        ).alias("json")
    )
    return documents.parse_documents(json, "json").withColumn("pos", F.col("pos").cast("long"))


@query(
    "s16_ranges",
    f"""WITH {ELEMENTS_SQL}, e AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pos AS BIGINT) AS pos, start_index, end_index, text, CASE WHEN pos % 2 = 1 THEN 3 ELSE 0 END AS down FROM elements)
        SELECT doc_id, start_index, end_index, CAST(depth + down AS INT) AS depth, kind, content FROM (
          SELECT doc_id, start_index, end_index, down, 1 AS depth, 'paragraph' AS kind, NULL AS content FROM e
          UNION ALL SELECT doc_id, start_index, end_index, down, 2, 'run', text FROM e
          UNION ALL SELECT doc_id, start_index, end_index, 0, 1, 'table', NULL FROM e WHERE down > 0
          UNION ALL SELECT doc_id, start_index, end_index, 0, 2, 'row', NULL FROM e WHERE down > 0
          UNION ALL SELECT doc_id, start_index, end_index, 0, 3, 'cell', NULL FROM e WHERE down > 0)""",
)
def s16_ranges(spark, sf):
    """Every other paragraph lies in a table cell: all ranges at all depths."""
    return documents.document_ranges(_nested_documents(spark, sf), "json").select("doc_id", "start_index", "end_index", "depth", "kind", "content")


def _nested_documents(spark, sf):
    from officelake.operators.ordering import ordered_lists

    e = inputs.elements(spark, sf)
    bounds = [F.col("start_index").alias("startIndex"), F.col("end_index").alias("endIndex")]
    run = F.struct(*bounds, F.struct(F.col("text").alias("content")).alias("textRun"))
    paragraph = F.struct(*bounds, F.struct(F.array(run).alias("elements")).alias("paragraph"))
    cell = F.struct(*bounds, F.array(paragraph).alias("content"))
    row = F.struct(*bounds, F.array(cell).alias("tableCells"))
    element = F.when(F.col("pos") % 2 == 1, F.to_json(F.struct(*bounds, F.struct(F.array(row).alias("tableRows")).alias("table")))).otherwise(F.to_json(paragraph))
    docs = ordered_lists(e, ["doc_id"], [F.col("pos")], element, "content")
    body = F.concat(F.lit('{"documentId":"'), F.col("doc_id").cast("string"), F.lit('","body":{"content":['), F.array_join("content", ","), F.lit("]}}"))
    return docs.select(body.alias("json"))


@query(
    "s16_rendered",
    f"""WITH {ELEMENTS_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(max(end_index) AS BIGINT) AS length,
        string_agg(regexp_replace(text, '[^A-Za-z]', '', 'g'), '' ORDER BY pos) AS letters FROM elements GROUP BY 1""",
)
def s16_rendered(spark, sf):
    """The texts of these documents put together from their ranges."""
    from officelake.operators import sections

    text = sections.render_text(documents.document_ranges(_nested_documents(spark, sf), "json"))
    return text.select("doc_id", F.length("text").cast("long").alias("length"), F.regexp_replace("text", "[^A-Za-z]", "").alias("letters"))


@query(
    "s17_query_source",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000",
)
def s17(spark, sf):
    return tables.query_source(
        spark,
        "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderstatus = 'O' AND o_totalprice > 100000",
        orders=table(spark, sf, "orders"),
    )


@query(
    "s18_load_index",
    f"""WITH {MAIL_SQL} SELECT thread_id AS id, arg_max(subject, turn) AS subject,
        arg_max(received_date, turn) AS received_date FROM mail GROUP BY thread_id""",
)
def s18(spark, sf):
    path = work_dir(spark, "index")
    mail = inputs.mail(spark, sf)
    # Saved with the legacy url field and one row per turn, so later turns replace earlier ones.
    saved = mail.select(
        F.col("thread_id").alias("id"), "subject", "received_date", F.lit("http://old").alias("url"), F.col("turn").alias("seq")
    )
    saved.write.json(path)
    out = mailbox.load_index(spark, path)
    assert out.columns == MAIL_INDEX.fieldNames()
    return out.select("id", "subject", "received_date")


@query(
    "s19_load_results",
    """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'other' ELSE 'useful' END AS category
       FROM labels WHERE quality = 1 OR toxic = 1""",
)
def s19(spark, sf):
    path = work_dir(spark, "results")
    labelled = (F.col("quality") == 1) | (F.col("toxic") == 1)
    rows = table(spark, sf, "labels").select(
        F.when(labelled, F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("toxic") == 1, "other").otherwise("useful").alias("category"),
    )
    rows.write.json(path)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("category", T.StringType())])
    return mailbox.load_results(spark, path, schema)


@query(
    "s20_expand_typed",
    """SELECT doc_id || CASE lang WHEN 'en' THEN '.json' WHEN 'fr' THEN '.log' ELSE '.txt' END AS path,
        CASE WHEN lang = 'en' THEN 'json' ELSE 'text' END AS kind,
        CASE WHEN lang = 'en' AND source = 'src1' THEN NULL ELSE text END AS text,
        CASE WHEN lang = 'en' AND source = 'src1' THEN 'invalid JSON' END AS error,
        CASE WHEN lang = 'fr' THEN 'unknown type read as text: log' END AS warning FROM documents""",
)
def s20(spark, sf):
    d = table(spark, sf, "documents")
    ext = F.when(F.col("lang") == "en", ".json").when(F.col("lang") == "fr", ".log").otherwise(".txt")
    json = F.to_json(F.struct(F.col("text").alias("t")))
    content = F.when(
        F.col("lang") == "en", F.when(F.col("source") == "src1", F.substring_index(json, "}", 1)).otherwise(json)
    ).otherwise(F.col("text"))
    rows = d.select(F.concat(F.col("doc_id").cast("string"), ext).alias("path"), F.encode(content, "UTF-8").alias("content"))
    out = files.expand_typed(rows)
    from_json = F.variant_get("json", "$.t", "string")
    return out.select("path", "kind", F.coalesce("text", from_json).alias("text"), "error", "warning")


@query(
    "s21_glob_filter",
    """SELECT page_id, url FROM pages WHERE regexp_matches(url, '^http://(?:.*?)?/[^/]*/[^/]*.page=.$')
       OR regexp_matches(url, '^https://(?:.*?)?/en/[^/]*$')""",
)
def s21(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    paged = files.glob_filter(pages, "url", "http://**/*/*?page=?")
    english = files.glob_filter(pages, "url", "https://**/en/*")
    return paged.union(english)


@query(
    "s22_task_batches",
    f"""WITH {TASKS_SQL} SELECT id AS batch, CASE WHEN status <> 'completed' THEN title END AS title,
        CASE WHEN status <> 'completed' THEN due END AS due,
        CASE WHEN status = 'completed' THEN 'expected a JSON array of tasks' END AS error FROM tasks""",
)
def s22(spark, sf):
    from officelake.schemas import MANAGED_TASK

    one = F.to_json(F.struct("title", "status", "due"))
    rows = inputs.tasks(spark, sf).select(
        F.col("id").alias("batch"),
        F.when(F.col("status") == "completed", one).otherwise(F.concat(F.lit("["), one, F.lit("]"))).alias("text"),
    )
    return tasks.parse_task_batch(rows, "text", MANAGED_TASK).select("batch", "task.title", "task.due", "error")
