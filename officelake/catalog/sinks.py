"""Bindings: sinks. Each query runs the real write into a new folder and reads the table back."""

from __future__ import annotations

from pyspark.sql import functions as F

from officelake.catalog import query
from officelake.catalog.scans import DRIVE_SQL, _drive
from officelake.operators.aggregates import action_summary
from officelake.plans import inputs
from officelake.plans.inputs import CALENDAR_SQL, CATEGORIES_SQL, MAIL_SQL, TASKS_SQL, table
from officelake.session import work_dir
from officelake.sinks import exports, merge, sync
from officelake.sinks.store import TableStore


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query(
    "k1_insert",
    "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def k1(spark, sf):
    store = TableStore(spark, work_dir(spark, "store"))
    orders = _orders(spark, sf)
    merge.insert(store, "orders", orders.where(F.col("o_orderstatus") == "F"), ["o_orderkey"])
    merge.insert(store, "orders", orders.where(F.col("o_orderstatus") != "F"), ["o_orderkey"])
    return store.read("orders")


@query(
    "k1_insert_conflicts",
    "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_linenumber = 1",
)
def k1_conflicts(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_linenumber") == 1).select(F.col("l_orderkey").alias("o_orderkey"))
    stored = _orders(spark, sf)
    return merge.conflicts(rows, stored, ["o_orderkey"]).distinct()


@query(
    "k2_upsert",
    """WITH src AS (SELECT l_orderkey AS k, arg_max(l_linestatus, (l_shipdate, l_partkey, l_suppkey)) AS st,
                     CASE WHEN max(l_quantity) > 45 THEN NULL ELSE max(l_extendedprice) END AS price
                     FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
            base AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT')
       SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE st END AS o_orderstatus,
              CASE WHEN k IS NULL THEN o_totalprice ELSE price END AS o_totalprice, o_orderpriority
       FROM base FULL JOIN src ON k = o_orderkey""",
)
def k2(spark, sf):
    store = TableStore(spark, work_dir(spark, "store"))
    store.replace("orders", _orders(spark, sf).where(F.col("o_orderpriority") != "1-URGENT"), ["o_orderkey"])
    returned = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    changes = returned.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max_by("l_linestatus", F.struct("l_shipdate", "l_partkey", "l_suppkey")).alias("o_orderstatus"),
        F.when(F.max("l_quantity") > 45, None).otherwise(F.max("l_extendedprice")).alias("o_totalprice"),
    )
    merge.upsert(store, "orders", changes, ["o_orderkey"])
    return store.read("orders")


def _nested(spark, sf):
    """A nested source per document: its analysis, and an action item per line."""
    d = table(spark, sf, "documents")
    items = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("title"), F.md5(line).alias("notes")))
    analysis = F.struct(
        F.col("lang").alias("category"), F.split(F.col("source"), "").alias("noteworthy_details"), items.alias("action_items")
    )
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.lit("mail").alias("type"),
        F.lit("2024-01-01").cast("timestamp").alias("created_time"),
        analysis.alias("analysis"),
    )


@query(
    "k2_upsert_repeated_keys",
    "SELECT o_custkey, max(o_orderkey) AS o_orderkey, count(*) * 0 + 1 AS stored FROM orders GROUP BY 1",
)
def k2_repeated(spark, sf):
    """Orders keyed by customer: every customer is stored once, with the latest order, in two upserts."""
    store = TableStore(spark, work_dir(spark, "store"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    for part in (o.where("o_orderkey % 2 = 0"), o):
        merge.upsert(store, "latest", part, ["o_custkey"], [F.col("o_orderkey")])
    return store.read("latest").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.count("*").alias("stored"))


@query(
    "k3_cascade_upsert",
    """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, CASE WHEN lang = 'en' THEN string_split(text, chr(10))[1:1]
                    WHEN lang = 'fr' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents)
       SELECT id AS analysis_id, CAST(i AS INT) AS action_number, lines[i + 1] AS title, md5(lines[i + 1]) AS notes,
              CASE WHEN lang = 'en' THEN 'short' ELSE lang END AS category
       FROM (SELECT *, unnest(range(len(lines))) AS i FROM t)""",
)
def k3(spark, sf):
    store = TableStore(spark, work_dir(spark, "store"))
    nested = _nested(spark, sf)
    merge.cascade_upsert(store, nested)
    # English sources come again with one item only, French ones without an analysis.
    a = F.col("analysis")
    short = a.withField("action_items", F.slice(a["action_items"], 1, 1)).withField("category", F.lit("short"))
    again = nested.where(a["category"].isin("en", "fr")).withColumn("analysis", F.when(a["category"] == "en", short))
    merge.cascade_upsert(store, again)
    analysis = store.read("analysis").select(F.col("id").alias("analysis_id"), "category")
    return store.read("action_item").join(analysis, "analysis_id")


@query(
    "k4_whole_commit",
    """SELECT 'orders' AS name, count(*) AS rows FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_linestatus = 'O'""",
)
def k4(spark, sf):
    store = TableStore(spark, work_dir(spark, "store"))
    txn = store.begin()
    txn.replace("orders", _orders(spark, sf).where(F.col("o_orderstatus") == "O"))
    txn.replace("lines", table(spark, sf, "lineitem").where(F.col("l_linestatus") == "O"))
    txn.commit()
    # Staged but never committed, so never visible.
    store.begin().append("orders", _orders(spark, sf).where(F.col("o_orderstatus") == "F"))
    counts = [store.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in ("orders", "lines")]
    return counts[0].unionByName(counts[1]).select("name", "rows")


@query(
    "k5_save_index",
    f"""WITH {MAIL_SQL}, j AS (SELECT md5(to_json({{'id': id, 'subject': subject, 'received_date': received_date}})) AS m FROM mail)
        SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(m, 1, 8) AS BIGINT)) AS BIGINT) AS word0,
               CAST(sum(CAST('0x' || substr(m, 9, 8) AS BIGINT)) AS BIGINT) AS word1,
               CAST(sum(CAST('0x' || substr(m, 17, 8) AS BIGINT)) AS BIGINT) AS word2,
               CAST(sum(CAST('0x' || substr(m, 25, 8) AS BIGINT)) AS BIGINT) AS word3, true AS first, false AS second
        FROM j""",
)
def k5(spark, sf):
    """Saved twice: the second time there is nothing to do."""
    path = work_dir(spark, "index")
    index = inputs.mail(spark, sf).select("id", "subject", "received_date")
    order = [F.col("received_date"), F.col("id")]
    first, second = exports.save_index(index, path, order), exports.save_index(index, path, order)
    saved = spark.read.schema(index.schema).json(path)
    return exports.content_digest(saved, saved.columns).withColumns({"first": F.lit(first), "second": F.lit(second)})


@query(
    "k5_save_index_changes",
    f"WITH {MAIL_SQL} SELECT id, subject, 'true,true,true,false' AS wrote FROM mail",
)
def k5_changes(spark, sf):
    """All, some, all again and the same once more: what is saved is what came last."""
    path, index = work_dir(spark, "index"), inputs.mail(spark, sf).select("id", "subject")
    some = index.where(F.col("id").endswith("0"))
    wrote = [exports.save_index(df, path, [F.col("id")]) for df in (index, some, index, index)]
    return spark.read.schema(index.schema).json(path).withColumn("wrote", F.lit(",".join(str(w).lower() for w in wrote)))


@query("k6_save_results", f"WITH {CATEGORIES_SQL} SELECT id, category FROM categories")
def k6(spark, sf):
    path = work_dir(spark, "results")
    results = inputs.categories(spark, sf)
    exports.save_index(results, path, [F.col("id")])
    return spark.read.schema(results.schema).json(path)


@query(
    "k7_mail_export",
    f"""WITH {MAIL_SQL} SELECT thread_id || '/' || id || '.msg' AS path,
        '{{"headers":[{{"name":"From","value":"' || senders || '"}}],"api_response":{{"id":"' || id || '"}}}}' AS meta,
        length(body) AS size FROM mail WHERE NOT (role = 'system')""",
)
def k7(spark, sf):
    mail = inputs.mail(spark, sf)
    root = work_dir(spark, "export")
    exports.write_messages(exports.mail_export_plan(mail.where(F.col("role").isin("system", "assistant"))), root)
    # Assistant mails exist as files but are missing in the index, so they are written again.
    existing = spark.read.parquet(root).select("path")
    plan = exports.mail_export_plan(mail, existing, mail.where(F.col("role") == "system"))
    headers = F.array(F.struct(F.lit("From").alias("name"), F.col("senders").alias("value")))
    meta = F.to_json(F.struct(headers.alias("headers"), F.struct("id").alias("api_response")))
    return plan.select("path", meta.alias("meta"), F.length("body").cast("long").alias("size"))


@query(
    "k8_drive_export",
    r"""WITH f AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages),
        n AS (SELECT page_id, CASE WHEN u LIKE '%/en/%' THEN CAST(page_id AS VARCHAR) ELSE regexp_replace(u, '^https?://', '') END AS name FROM f)
        SELECT page_id AS id, regexp_replace(name, '\.[^./]*$', '') || '.md' AS path FROM n WHERE name NOT LIKE '%/fr/%'""",
)
def k8(spark, sf):
    url = F.regexp_replace("url", r"[?#].*$", "")
    name = F.when(~url.contains("/en/"), F.regexp_replace(url, "^https?://", ""))
    found = table(spark, sf, "pages").select(F.col("page_id").alias("id"), name.alias("name"))
    existing = exports.drive_export_plan(found.where(F.col("name").contains("/fr/")), as_markdown=True)
    return exports.drive_export_plan(found, existing, as_markdown=True).select("id", "path")


@query(
    "k9_drive_listing",
    f"""WITH {DRIVE_SQL} SELECT CAST(id AS VARCHAR) AS id, name,
        CASE mimeType WHEN 'text/html' THEN '.html' WHEN 'text/plain' THEN '.txt' WHEN 'application/pdf' THEN '.pdf' ELSE '' END AS "fileExtension",
        coalesce(mimeType, '') AS "mimeType", description, md5Checksum AS "md5Checksum", '' AS "modifiedTime" FROM drive""",
)
def k9(spark, sf):
    listing = exports.drive_listing(_drive(spark, sf))
    path = work_dir(spark, "listing")
    exports.write_listing(listing, path)
    back = spark.read.schema(listing.schema).csv(path, sep="\t", header=True)
    return back.fillna("")


@query(
    "k10_calendar_listing",
    f"""WITH {CALENDAR_SQL} SELECT id, summary, location,
        CASE WHEN summary <> 'view' THEN strftime(make_timestamp(start_us), '%Y-%m-%dT%H:%M:%SZ') END AS start,
        CASE WHEN summary <> 'view' THEN strftime(make_timestamp(end_us), '%Y-%m-%dT%H:%M:%SZ') END AS "end" FROM calendar""",
)
def k10(spark, sf):
    def side(us):
        at = F.timestamp_micros(us)
        timed = F.date_format(at, inputs.ISO_Z)
        all_day = F.col("summary") == "view"
        return F.struct(
            F.when(all_day, F.date_format(at, "yyyy-MM-dd")).alias("date"), F.when(~all_day, timed).alias("dateTime")
        )

    e = inputs.calendar(spark, sf)
    e = e.withColumn("start", side(F.col("start_us"))).withColumn("end", side(F.col("end_us")))
    return exports.calendar_listing(e)


@query(
    "k11_task_lines",
    f"""WITH {TASKS_SQL} SELECT id || chr(9) || title || chr(9) || status || chr(9) ||
        CASE WHEN notes LIKE chr(128279) || '%' THEN 'http://t/' || id ELSE '' END AS line FROM tasks""",
)
def k11(spark, sf):
    from officelake.sources.tasks import managed_tasks

    return exports.task_lines(managed_tasks(inputs.tasks(spark, sf), include_plain=True))


@query(
    "k12_sheet_rows_json",
    """SELECT '{"order":' || l_orderkey || ',"part":' || l_partkey || ',"flag":"' || l_returnflag || '"'
          || CASE WHEN l_linestatus = 'O' THEN ',"open":true' ELSE '' END || '}' AS row FROM lineitem""",
)
def k12(spark, sf):
    li = table(spark, sf, "lineitem")
    row = F.struct(
        F.col("l_orderkey").alias("order"),
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linestatus") == "O", F.lit(True)).alias("open"),
    )
    return li.select(F.to_json(row).alias("row"))


@query(
    "k13_update_or_create",
    """WITH n AS (SELECT split_part(text, chr(10), 1) AS name, count(*) AS c FROM documents WHERE lang <> 'fr' GROUP BY 1)
       SELECT d.doc_id, CASE WHEN n.c = 1 THEN 'update' ELSE 'create' END AS action
       FROM documents d LEFT JOIN n ON n.name = split_part(d.text, chr(10), 1)""",
)
def k13(spark, sf):
    from officelake.sources.files import unique_by_name

    files = _drive(spark, sf)
    stored = unique_by_name(files.join(table(spark, sf, "documents").where("lang <> 'fr'").select(F.col("doc_id").alias("id")), "id"))
    requests = files.select(F.col("id").alias("doc_id"), "name")
    return merge.classify_update(requests, stored.where(F.col("id").isNotNull()), "name").select("doc_id", "action")


@query(
    "k14_event_changes",
    f"""WITH {CALENDAR_SQL}, e AS (SELECT *, CASE WHEN summary <> 'signup' THEN id END AS own FROM calendar)
        SELECT own AS id, CASE summary WHEN 'signup' THEN 'create' WHEN 'error' THEN 'error' ELSE 'update' END AS action,
        '{{' || CASE WHEN own IS NOT NULL THEN '"id":' || own || ',' ELSE '' END || '"summary":"' || summary || '"'
             || CASE WHEN end_us - start_us > 3600000000 THEN ',"location":"' || location || '"' ELSE '' END || '}}' AS body
        FROM e""",
)
def k14(spark, sf):
    e = inputs.calendar(spark, sf)
    location = F.when(F.col("end_us") - F.col("start_us") > 3_600_000_000, F.col("location"))
    asked = e.select(F.when(F.col("summary") != "signup", F.col("id")).alias("id"), "summary", location.alias("location"))
    return sync.event_changes(asked, e.where(F.col("summary") != "error"))


def _changes(stored):
    """One change per finished or urgent order, and one new task per order."""
    op = F.when(F.col("status") == "completed", "D").when(F.col("notes").contains("1-URGENT"), "M").when(
        F.col("notes").contains("2-HIGH"), "U"
    )
    changed = stored.withColumn("op", op).where(F.col("op").isNotNull())
    changed = changed.withColumn("title", F.concat("title", F.lit(" changed"))).withColumn("tasklist_id", F.col("tasklist_id") + 1)
    new = stored.where(F.col("status") == "completed").withColumn("id", -F.col("id") - 1).withColumn("op", F.lit("I"))
    lost = stored.where(F.col("hidden")).withColumn("id", -F.col("id") - 1000000000).withColumn("op", F.lit("U"))
    return changed.unionByName(new).unionByName(lost)


@query(
    "k15_apply_changes",
    f"""WITH {TASKS_SQL}
        SELECT id, CASE WHEN status <> 'completed' AND notes NOT LIKE '%1-URGENT%' AND notes LIKE '%2-HIGH%' THEN title || ' changed' ELSE title END AS title,
               CASE WHEN status <> 'completed' AND (notes LIKE '%1-URGENT%' OR notes LIKE '%2-HIGH%') THEN tasklist_id + 1 ELSE tasklist_id END AS tasklist_id,
               CASE WHEN status = 'completed' THEN 'deleted' WHEN notes LIKE '%1-URGENT%' THEN 'moved'
                    WHEN notes LIKE '%2-HIGH%' THEN 'updated' ELSE 'kept' END AS outcome FROM tasks
        UNION ALL SELECT -id - 1, title, tasklist_id, 'inserted' FROM tasks WHERE status = 'completed'
        UNION ALL SELECT -id - 1000000000, NULL, NULL, 'error: id not found' FROM tasks WHERE hidden""",
)
def k15(spark, sf):
    stored = inputs.tasks(spark, sf)
    return merge.apply_changes(stored, _changes(stored), "id").select("id", "title", "tasklist_id", "outcome")


def _incoming(spark, sf):
    t = inputs.tasks(spark, sf)
    kind = F.substring("notes", -1, 1)  # the last letter of the priority spreads the cases over all tasks
    title = F.when(kind == "T", F.concat("title", F.lit(" changed"))).otherwise(F.col("title"))
    id_ = F.when(kind == "W", F.col("id") + 100000000).when(kind == "H", None).otherwise(F.col("id"))
    return t.withColumn("title", title).withColumn("id", id_).withColumn("position", F.lit(0.0))


K16_ACTION = """CASE right(notes, 1) WHEN 'W' THEN 'error' WHEN 'H' THEN 'create' WHEN 'T' THEN 'update' ELSE 'noop' END"""


@query(
    "k16_upsert_task",
    f"""WITH {TASKS_SQL} SELECT CASE right(notes, 1) WHEN 'W' THEN id + 100000000 WHEN 'H' THEN NULL ELSE id END AS id,
        CASE right(notes, 1) WHEN 'T' THEN title || ' changed' ELSE title END AS title, {K16_ACTION} AS action FROM tasks""",
)
def k16(spark, sf):
    return sync.upsert_tasks(_incoming(spark, sf), inputs.tasks(spark, sf)).select("id", "title", "action")


@query("a8_action_summary", f"WITH {TASKS_SQL} SELECT {K16_ACTION} AS action, count(*) AS rows FROM tasks GROUP BY 1")
def a8(spark, sf):
    return action_summary(sync.upsert_tasks(_incoming(spark, sf), inputs.tasks(spark, sf)))


@query(
    "k17_upsert_managed_task",
    f"""WITH {TASKS_SQL}, c AS (SELECT *, right(notes, 1) AS k, notes LIKE chr(128279) || '%' AS managed FROM tasks)
        SELECT 'http://t/' || id AS id_url, CASE WHEN managed THEN id END AS id,
               CASE WHEN k = 'H' THEN 'elsewhere' WHEN NOT managed AND k = 'W' THEN '@default' ELSE CAST(tasklist_id AS VARCHAR) END AS tasklist_id,
               CASE WHEN k IN ('T', 'H') THEN title || ' changed' ELSE title END AS title,
               CASE WHEN NOT managed THEN 'create' WHEN k = 'H' THEN 'move,update' WHEN k = 'T' THEN 'update' ELSE 'noop' END AS actions
        FROM c WHERE managed OR k <> 'Y'""",
)
def k17(spark, sf):
    stored = inputs.tasks(spark, sf).withColumn("tasklist_id", F.col("tasklist_id").cast("string"))
    kind = F.substring("notes", -1, 1)
    managed = F.col("notes").startswith("\U0001f517")
    title = F.when(kind.isin("T", "H"), F.concat("title", F.lit(" changed"))).when(managed & (kind == "M"), None).otherwise(F.col("title"))
    place = F.when(kind == "H", "elsewhere").when(kind == "W", None).otherwise(F.col("tasklist_id"))
    incoming = stored.where(managed | (kind != "Y")).select(
        F.concat(F.lit("http://t/"), F.col("id").cast("string")).alias("id_url"),
        title.alias("title"),
        place.alias("tasklist_id"),
        F.when(~managed, F.col("notes")).otherwise(F.element_at(F.split("notes", "\n"), 2)).alias("notes"),
        F.lit(None).cast("string").alias("status"),
    )
    out = sync.upsert_managed(incoming, stored, [F.col("tasklist_id"), F.col("id")])
    return out.select("id_url", "id", "tasklist_id", "title", F.array_join("actions", ",").alias("actions"))


@query(
    "k19_digest",
    f"""WITH {CATEGORIES_SQL} SELECT category, count(*) AS items,
        string_agg(id || ' ' || split_part(text, chr(10), 1), chr(10) ORDER BY id) AS summary
        FROM categories JOIN documents ON doc_id = id GROUP BY category""",
)
def k19(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("subject"))
    items = inputs.categories(spark, sf).join(d, "id")
    return exports.digest(items, "category", [F.col("id")], F.concat_ws(" ", "id", "subject"))


@query(
    "k19_digest_lines",
    f"""WITH {CATEGORIES_SQL} SELECT category, row_number() OVER (PARTITION BY category ORDER BY id) - 1 AS position,
        count(*) OVER (PARTITION BY category) AS items, id || ' ' || split_part(text, chr(10), 1) AS line
        FROM categories JOIN documents ON doc_id = id""",
)
def k19_lines(spark, sf):
    """Every line of the summaries with its place, as the written files have them."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("subject"))
    items = inputs.categories(spark, sf).join(d, "id")
    return exports.digest_lines(items, "category", [F.col("id")], F.concat_ws(" ", "id", "subject"))
