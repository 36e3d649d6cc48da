"""Bindings: end-to-end jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from officelake.catalog import query
from officelake.catalog.bus_and_rules import LOG_SQL, log
from officelake.catalog.functions import TODO_SQL, TRIAGE_SETTINGS, _triage_sql
from officelake.catalog.texts import RENDERED_SQL
from officelake.catalog.inference import CATEGORY_SQL, INSTRUCTIONS_SIZE, PROMPT_WEIGHT_SQL, classify_prompt, weight_sql
from officelake.functions.jsons import decode_json
from officelake.functions.template import Template
from officelake.inference import model
from officelake.inference.stub import EDITS, LISTS, SINGLE, TRIAGE, weight
from officelake.operators.ordering import batches
from officelake.plans import inputs, jobs
from officelake.plans.inputs import ITEMS_SQL, MAIL_SQL, table
from officelake.session import work_dir
from officelake.sinks.exports import save_index
from officelake.sinks.store import TableStore
from officelake.sources.mailbox import load_results
from officelake.streaming import jobs as stream_jobs
from officelake.streaming.receive import deliveries

NOW = "2024-03-01"


def _now():
    return F.lit(NOW).cast("timestamp")


def _store(spark):
    return TableStore(spark, work_dir(spark, "store"))


def _documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "n_chars", "lang")


def _done(spark, sf):
    return inputs.categories(spark, sf).select(F.col("id").cast("string").alias("id"), "category")


@query(
    "e2e0_categorise_new_documents",
    f"""WITH q AS (SELECT doc_id, {PROMPT_WEIGHT_SQL} AS n FROM documents
                   WHERE doc_id NOT IN (SELECT doc_id FROM labels))
        SELECT CAST(doc_id AS VARCHAR) AS id, {CATEGORY_SQL.format(n='n')} AS category FROM q
        UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN toxic = 1 THEN 'other' WHEN quality = 1 THEN 'useful' ELSE 'unknown' END FROM labels""",
)
def e2e0(spark, sf):
    store, done = _store(spark), _done(spark, sf)
    store.replace("results", done, ["id"])
    return jobs.categorise_and_store(store, _documents(spark, sf), done, SINGLE)


TRIAGE_HEAD_SQL = """'id: ' || id || chr(10) || 'Subject: ' || subject || chr(10) || 'From: ' || senders || chr(10) || 'Received: ' || received_date"""
ANALYSIS_INSTRUCTIONS = weight(model.object_instructions(jobs.ANALYSIS_ANSWER)) + 1


def _messages(spark, sf):
    return inputs.mail(spark, sf).withColumnRenamed("body", "content")


def _by_date():
    return [F.col("received_date"), F.col("id")]


TRIAGE_SQL = f"""{MAIL_SQL}, q AS (SELECT id, subject, {weight_sql('(' + _triage_sql('(' + TRIAGE_HEAD_SQL + ')', 'body') + ')')} + {ANALYSIS_INSTRUCTIONS} AS n FROM mail)"""


def _triaged(spark, sf):
    store, mail = _store(spark), _messages(spark, sf)
    # A first run takes one page of mails, the second all others.
    jobs.mail_triage(store, mail, TRIAGE, TRIAGE_SETTINGS, _by_date(), _now())
    jobs.mail_triage(store, mail, TRIAGE, TRIAGE_SETTINGS, _by_date(), _now(), limit=None)
    return store


@query(
    "e2e1_mail_triage",
    f"""WITH {TRIAGE_SQL}
        SELECT id, 'mail' AS type, {CATEGORY_SQL.format(n='n')} AS category, subject, id || '.msg' AS path, 'P' || n % 11 AS person FROM q""",
)
def e2e1(spark, sf):
    store = _triaged(spark, sf)
    out = store.read("source").join(store.read("analysis"), "id").join(store.read("mail_metadata"), "id")
    return out.select("id", "type", "category", "subject", "path", F.col("people")[0]["name"].alias("person"))


@query(
    "e2e1_stored_todos",
    f"""WITH {TRIAGE_SQL}, t AS (SELECT id, n, unnest(range(n % 3)) AS i FROM q)
        SELECT id AS analysis_id, CAST(i AS INT) AS action_number, 'Do ' || (n + i) AS title, id AS message_id FROM t""",
)
def e2e1_todos(spark, sf):
    """To-dos of all mails with the message they lead back to, over all tables of the cascade."""
    store = _triaged(spark, sf)
    way = store.read("mail_source").join(store.read("mail_metadata").withColumnRenamed("id", "mail_metadata_id"), "mail_metadata_id")
    way = way.select("id", "mail_data_id").join(store.read("gmail_message").select(F.col("id").alias("mail_data_id")), "mail_data_id")
    items = store.read("action_item").select("analysis_id", "action_number", "title")
    return items.join(way.select(F.col("id").alias("analysis_id"), F.col("mail_data_id").alias("message_id")), "analysis_id")


def _todos(spark, sf):
    """Open order lines as to-dos for the document with the number of their supplier."""
    items = inputs.action_items(spark, sf)
    seq = F.struct("analysis_id", "action_number")
    return items.withColumns({"doc_id": F.col("l_suppkey"), "seq": seq})


E2E2_ITEMS = f"""{ITEMS_SQL}, todo AS (SELECT *, {TODO_SQL} AS markdown FROM items
       WHERE coalesce(priority, '') ILIKE 'high%' OR coalesce(priority, '') ILIKE 'critical%')"""


@query(
    "e2e2_placements",
    f"""WITH {E2E2_ITEMS} SELECT CAST(analysis_id AS VARCHAR) AS analysis_id, CAST(action_number AS INT) AS action_number,
        'doc://' || l_suppkey AS placement_container_url, '(None)' AS placement_id FROM todo""",
)
def e2e2(spark, sf):
    return _place(spark, sf)[0].read("placement")


@query(
    "e2e2_documents",
    f"""WITH {E2E2_ITEMS}, t AS (SELECT l_suppkey AS doc_id, string_agg(markdown, '' ORDER BY analysis_id DESC, action_number DESC) AS added FROM todo GROUP BY 1)
        SELECT d.doc_id, md5(coalesce(t.added, '') || d.text) AS digest FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id""",
)
def e2e2_documents(spark, sf):
    return _place(spark, sf)[1].select("doc_id", F.md5("text").alias("digest"))


def _place(spark, sf):
    store = _store(spark)
    url = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    todos = _todos(spark, sf).withColumn("analysis_id", F.col("analysis_id").cast("string")).withColumn(
        "action_number", F.col("action_number").cast("int")
    )
    texts = table(spark, sf, "documents").select("doc_id", "text")
    edited = jobs.place_todos(
        store, todos, texts, url, F.lit(1), [F.col("seq")], priority="high|critical", limit=None
    )
    return store, edited


@query(
    "e2e2_second_run",
    f"""WITH {E2E2_ITEMS}, t AS (SELECT l_suppkey AS doc_id, string_agg(markdown, '' ORDER BY priority ILIKE 'critical%', analysis_id DESC, action_number DESC) AS added FROM todo GROUP BY 1)
        SELECT d.doc_id, md5(t.added || d.text) AS digest FROM documents d JOIN t ON t.doc_id = d.doc_id""",
)
def e2e2_second_run(spark, sf):
    """Critical to-dos first, then all urgent ones with the documents handed in as they were: both runs' texts stay."""
    store = _store(spark)
    todos = _todos(spark, sf).withColumn("analysis_id", F.col("analysis_id").cast("string")).withColumn("action_number", F.col("action_number").cast("int"))
    texts = table(spark, sf, "documents").select("doc_id", "text")
    url = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    for priority in ("critical", "high|critical"):
        jobs.place_todos(store, todos, texts, url, F.lit(1), [F.col("seq")], priority=priority, limit=None)
    return store.read("edited").select("doc_id", F.md5("text").alias("digest"))


@query(
    "e2e2_model_edits",
    f"""WITH {ITEMS_SQL}, i AS (SELECT l_suppkey AS doc_id, analysis_id, action_number, title, action_number * 7 - 3 AS wanted
            FROM items WHERE priority ILIKE 'critical%' AND action_number <= 3),
        o AS (SELECT doc_id, string_agg(title, '' ORDER BY analysis_id DESC) AS added FROM i WHERE action_number = 0 GROUP BY 1),
        c AS (SELECT d.doc_id, coalesce(o.added, '') || d.text AS text, o.added IS NOT NULL AS touched FROM documents d LEFT JOIN o USING (doc_id)),
        p AS (SELECT i.*, c.text, greatest(least(wanted, length(c.text)), 1) AS spot FROM i JOIN c USING (doc_id) WHERE action_number > 0 AND wanted <= length(c.text) + 4),
        g AS (SELECT doc_id, text, spot, string_agg(title, '' ORDER BY analysis_id DESC, action_number DESC) AS added FROM p GROUP BY ALL),
        w AS (SELECT *, lag(spot, 1, 1) OVER (PARTITION BY doc_id ORDER BY spot) AS start FROM g),
        f AS (SELECT doc_id, string_agg(substr(text, start, spot - start) || added, '' ORDER BY spot) || substr(any_value(text), max(spot)) AS text FROM w GROUP BY doc_id)
        SELECT doc_id, md5(coalesce(f.text, c.text)) AS digest FROM c LEFT JOIN f USING (doc_id) WHERE touched OR f.text IS NOT NULL""",
)
def e2e2_model_edits(spark, sf):
    """A model says where critical to-dos go, in two runs: the second one sees what the first one has written."""
    store = _store(spark)
    todos = _todos(spark, sf).withColumn("analysis_id", F.col("analysis_id").cast("string")).withColumn("action_number", F.col("action_number").cast("int"))
    texts = table(spark, sf, "documents").select("doc_id", "text")
    url = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    for part in (todos.where("action_number = 0"), todos.where("action_number <= 3")):
        jobs.place_todos(store, part, texts, url, F.lit(1), [F.col("seq")], priority="critical", limit=None, model=EDITS)
    return store.read("edited").select("doc_id", F.md5("text").alias("digest"))


@query(
    "e2e3_categorise_and_refine",
    f"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS id, n_chars, {PROMPT_WEIGHT_SQL} AS n FROM documents
                   WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
        f AS (SELECT *, {CATEGORY_SQL.format(n='n_chars')} AS first FROM p)
        SELECT id, CASE WHEN first IN ('unknown', 'other') THEN {CATEGORY_SQL.format(n='n')} ELSE first END AS category FROM f""",
)
def e2e3(spark, sf):
    second = Template("id: {{ id }}\n{{ text }}").render(id=F.col("id"), text=F.col("text"))
    out = jobs.categorise(
        _documents(spark, sf), _done(spark, sf), [F.col("id")], classify_prompt(), LISTS,
        model.joined_prompt(SINGLE, second), SINGLE,
    ).select("id", "category")
    path = work_dir(spark, "results")
    save_index(out, path, [F.col("id")])
    return load_results(spark, path, out.schema)


@query(
    "e2e4_export_with_index",
    f"""WITH {MAIL_SQL} SELECT thread_id || '/' || id || '.msg' AS path, subject, md5(body) AS digest FROM mail""",
)
def e2e4(spark, sf):
    root, index = work_dir(spark, "export"), work_dir(spark, "index")
    rows = jobs.export_mail(inputs.mail(spark, sf), root, index, _by_date())
    saved = spark.read.schema(rows.schema).json(index).select("path", "subject")
    files = spark.read.parquet(root).select("path", F.md5("content").alias("digest"))
    return saved.join(files, "path")


@query(
    "e2e4_saved_in_parts",
    f"""WITH {MAIL_SQL} SELECT thread_id || '/' || id || '.msg' AS path, subject, md5(body) AS digest FROM mail""",
)
def e2e4_parts(spark, sf):
    """The index is saved after every quarter of the mails."""
    root, index, mail = work_dir(spark, "export"), work_dir(spark, "index"), inputs.mail(spark, sf)
    rows = jobs.export_mail(mail, root, index, _by_date(), save_every=mail.count() // 4 + 1)
    saved = spark.read.schema(rows.schema).json(index).select("path", "subject")
    return saved.join(spark.read.parquet(root).select("path", F.md5("content").alias("digest")), "path")


@query(
    "e2e4_export_twice",
    f"""WITH {MAIL_SQL} SELECT thread_id || '/' || id || '.msg' AS path, md5(body) AS digest, CAST(1 AS BIGINT) AS written, CAST(1 AS BIGINT) AS indexed FROM mail""",
)
def e2e4_twice(spark, sf):
    """A first export of some mails, one of all, and one more: every mail is written and indexed once."""
    root, index, mail = work_dir(spark, "export"), work_dir(spark, "index"), inputs.mail(spark, sf)
    for part in (mail.where("role = 'user'"), mail, mail):
        rows = jobs.export_mail(part, root, index, _by_date())
    saved = spark.read.schema(rows.schema).json(index).groupBy("id").agg(F.count("*").alias("indexed"))
    saved = saved.join(mail.select("id", F.concat("thread_id", F.lit("/"), "id", F.lit(".msg")).alias("path")), "id").drop("id")
    files = spark.read.parquet(root).groupBy("path").agg(F.first(F.md5("content")).alias("digest"), F.count("*").alias("written"))
    return files.join(saved, "path")


@query(
    "e2e2_unknown_documents",
    f"""WITH {E2E2_ITEMS} SELECT CAST(analysis_id AS VARCHAR) AS analysis_id, CAST(action_number AS INT) AS action_number,
        l_suppkey % 2 = 0 AS placed FROM todo""",
)
def e2e2_unknown(spark, sf):
    """Only every other document is there: to-dos of the others are left for later."""
    store = _store(spark)
    todos = _todos(spark, sf).withColumn("analysis_id", F.col("analysis_id").cast("string")).withColumn("action_number", F.col("action_number").cast("int"))
    texts = table(spark, sf, "documents").select("doc_id", "text").where("doc_id % 2 = 0")
    url = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    jobs.place_todos(store, todos, texts, url, F.lit(1), [F.col("seq")], priority="high|critical", limit=None)
    done, left = (store.read(n).select("analysis_id", "action_number", F.lit(n == "placement").alias("placed")) for n in ("placement", "unplaced"))
    return done.unionByName(left)


@query(
    "e2e5_todos_to_tasks",
    f"""{RENDERED_SQL}, q AS (SELECT page_id, {weight_sql("('id: ' || page_id || chr(10) || value)")} AS n FROM rendered)
        SELECT 'http://pages/' || page_id AS id_url, 'Read: ' || {CATEGORY_SQL.format(n='n')} AS title,
        '@default' AS tasklist_id, 'create' AS actions FROM q
        UNION ALL SELECT 'http://pages/-1', NULL, NULL, 'error' FROM (SELECT count(*) FROM pages)""",
)
def e2e5(spark, sf):
    stored = inputs.tasks(spark, sf).withColumn("tasklist_id", F.col("tasklist_id").cast("string"))
    pages = inputs.texts(spark, sf, "pages").select("page_id", "html")
    # one more page, without anything to read
    pages = pages.unionByName(pages.agg(F.lit(-1).cast("long").alias("page_id"), F.lit("<p><br></p>").alias("html")))
    out = jobs.todos_to_tasks(pages, "html", "page_id", SINGLE, stored, [F.col("tasklist_id"), F.col("id")])
    return out.select("id_url", "title", "tasklist_id", F.array_join("actions", ",").alias("actions"))


_CHECK_SQL = """'id: ' || doc_id || chr(10) || 'Check the document below and suggest improvements as JSON.' || chr(10) || chr(10) || text"""


@query(
    "e2e6_self_check",
    f"""WITH q AS (SELECT doc_id, {weight_sql('(' + _CHECK_SQL + ')')} + {INSTRUCTIONS_SIZE} AS n FROM documents WHERE lang <> 'fr')
        SELECT doc_id, {CATEGORY_SQL.format(n='n')} AS category FROM q""",
)
def e2e6(spark, sf):
    docs = table(spark, sf, "documents")
    # French documents were checked as they are, German ones in an earlier version.
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("old"))).otherwise(F.col("text"))
    checked = docs.where("lang IN ('fr', 'de')").select("doc_id", F.md5(text).alias("content_hash"))
    return jobs.self_check(docs, checked, SINGLE).select("doc_id", "result.value.category")


@query("x13_extraction_prompts", f"SELECT doc_id, md5({_CHECK_SQL}) AS digest FROM documents")
def x13(spark, sf):
    d = table(spark, sf, "documents")
    text = Template(jobs.CHECK_TEMPLATE).render(name=F.col("doc_id"), text=F.col("text"))
    return d.select("doc_id", F.md5(text).alias("digest"))


@query(
    "m7_edit_generation",
    f"""WITH {ITEMS_SQL} SELECT analysis_id || '|' || action_number AS origin, 'insert' AS kind, greatest(least(action_number * 7 - 3, 49), 1) AS index,
          CAST(NULL AS BIGINT) AS "end", title AS content, CASE WHEN action_number * 7 - 3 > 53 THEN 'far beyond document end' END AS error FROM items
        UNION ALL SELECT analysis_id || '|' || action_number, 'delete', 5, least(9 + action_number, 49), NULL, NULL FROM items WHERE action_number > 3""",
)
def m7(spark, sf):
    items = inputs.action_items(spark, sf).select(
        F.concat_ws("|", "analysis_id", "action_number").alias("origin_id"), "action_number", "title"
    )
    grouped = batches(items, [F.col("origin_id")], 5)
    prompt = F.concat(F.lit("Where do these items belong?\n"), F.to_json("items"))
    edits, failed = jobs.model_edits(grouped, prompt, EDITS, F.lit(50).cast("long"))
    assert not failed.take(1)
    return edits.select(F.col("origin_ids")[0].alias("origin"), "kind", "index", "end", "content", "error")


def _files(spark, rows, arrivals=3):
    """(folder, files of an arrival): rows as files that arrive in three lots, written by as many tasks as read them."""
    path = work_dir(spark, "arrivals")
    each = -(-rows.rdd.getNumPartitions() // arrivals)
    rows.repartition(each * arrivals).write.parquet(path)
    return path, each


def _run(job, spark, arrivals, schema):
    stream = stream_jobs.file_stream(spark, arrivals[0], schema, arrivals[1])
    job.finish(job.start(stream, work_dir(spark, "progress")))
    return job


@query("t1_polled_job", "SELECT event_id, event_type, value * 2 AS twice FROM events")
def t1(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")

    def process(df):
        value = F.struct("event_type", (F.col("value") * 2).alias("twice"))
        return df.select("event_id", value.alias("value"), F.lit(None).cast("string").alias("error"))

    job = stream_jobs.PolledJob(_store(spark), "doubled", "event_id", [F.col("value")], process)
    return _run(job, spark, _files(spark, e), e.schema).store.read("doubled")


@query(
    "t1_failures_do_not_block",
    """SELECT event_type, count(*) FILTER (event_id % 1000 > 0) AS stored, count(*) FILTER (event_id % 1000 = 0) AS pending FROM events GROUP BY 1""",
)
def t1_failures(spark, sf):
    """Every thousandth event fails each time, and a run takes a third of them: two more runs and the rest is stored."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    # failing events have the smallest keys
    e = e.withColumn("rank", F.col("event_id") + F.when(F.col("event_id") % 1000 == 0, F.lit(-(10**12))).otherwise(0))

    def process(df):
        failing = F.col("event_id") % 1000 == 0
        return df.select("rank", F.when(~failing, F.struct("event_type")).alias("value"), F.when(failing, "broken").alias("error"))

    store, (path, _), progress = _store(spark), _files(spark, e), work_dir(spark, "progress")
    job = stream_jobs.PolledJob(store, "kept", "rank", [F.col("event_type")], process, limit=e.count() // 2)
    for _ in range(3):
        job.finish(job.start(stream_jobs.file_stream(spark, path, e.schema), progress), e.schema)
    kept = store.read("kept").groupBy("event_type").agg(F.count("*").alias("stored"))
    left = store.read("pending").groupBy("event_type").agg(F.count("*").alias("n"))
    return kept.join(left, "event_type", "left").select("event_type", "stored", F.coalesce("n", F.lit(0)).alias("pending"))


@query("t2_incremental_state", "SELECT event_type, CAST(0 AS BIGINT) AS seen_before, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def t2(spark, sf):
    e = table(spark, sf, "events").select(F.concat_ws("/", "event_type", "user_id").alias("id"), "event_type", "user_id")

    store = _store(spark)

    def process(df):
        """Each new id with whether an earlier run has stored it (none should be handed on twice)."""
        stored = store.read("pairs").select("id") if store.exists("pairs") else df.select("id").limit(0)
        df = df.join(stored.withColumn("seen", F.lit(1)), "id", "left")
        value = F.struct("event_type", "user_id", F.coalesce("seen", F.lit(0)).alias("seen"))
        return df.select("id", value.alias("value"), F.lit(None).cast("string").alias("error"))

    job = stream_jobs.PolledJob(store, "pairs", "id", [F.col("user_id")], process)
    rows = _run(job, spark, _files(spark, e), e.schema).store.read("pairs")
    return rows.groupBy("event_type").agg(F.sum("seen").alias("seen_before"), F.count("*").alias("users"))


@query(
    "t3_error_isolation",
    """SELECT conv_id || '-' || turn AS id, CASE WHEN role <> 'system' THEN text END AS text,
       CASE WHEN role = 'system' THEN 'JSON is not in known format' END AS error FROM conversations""",
)
def t3(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", "role")

    def process(df):
        json = F.to_json(F.struct("text"))
        answer = decode_json(F.when(F.col("role") == "system", F.concat(F.lit("No: "), json)).otherwise(json))
        value = F.struct(F.variant_get(answer["value"], "$.text", "string").alias("text"))
        return df.select("id", F.when(answer["error"].isNull(), value).alias("value"), answer["error"].alias("error"))

    job = stream_jobs.PolledJob(_store(spark), "texts", "id", [F.col("role")], process)
    store = _run(job, spark, _files(spark, c), c.schema).store
    return store.read("texts").unionByName(store.read("failures"), allowMissingColumns=True)


@query(
    "t5_streamed_log",
    f"WITH {LOG_SQL} SELECT topic, count(*) AS messages, count(*) AS ids FROM log GROUP BY topic",
)
def t5_stream(spark, sf):
    rows = log(spark, sf).select("topic", "message", "sender", F.col("id").alias("event"))
    store = _store(spark)
    path, each = _files(spark, rows)
    stream = stream_jobs.file_stream(spark, path, rows.schema, each)
    stream_jobs.append_log(stream, store, "log", [F.col("event")], work_dir(spark, "progress")).awaitTermination()
    out = store.read("log")
    return out.groupBy("topic").agg(F.count("*").alias("messages"), F.countDistinct("id").alias("ids"))


def _inboxes(spark, sf):
    """Messages with an inbox per user as topic, which only that user's agent listens to."""
    rows = log(spark, sf).withColumn("topic", F.concat(F.lit("inbox-"), "sender"))
    return rows.select("topic", "id", "message"), rows.select(F.col("sender").alias("agent"), "topic").distinct()


@query(
    "t6_streamed_deliveries",
    f"""WITH {LOG_SQL} SELECT sender AS agent, 'inbox-' || sender AS topic, count(*) AS messages, max(id) AS last_id FROM log GROUP BY 1, 2""",
)
def t6_stream(spark, sf):
    rows, known = _inboxes(spark, sf)
    path, each = _files(spark, rows)  # ids come in no order: later lots have ids between those of earlier ones
    stream = stream_jobs.file_stream(spark, path, rows.schema, each)
    target = work_dir(spark, "deliveries")
    out = deliveries(stream, known).writeStream.format("parquet").option("checkpointLocation", work_dir(spark, "progress"))
    out.option("path", target).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(target)
    return got.groupBy("agent", "topic").agg(F.count("*").alias("messages"), F.max("id").alias("last_id"))


@query(
    "t7_receive_timeout",
    f"WITH {LOG_SQL} SELECT DISTINCT sender AS agent, 'timeout' AS status FROM log UNION ALL SELECT DISTINCT 'silent-' || topic, 'timeout' FROM log",
)
def t7(spark, sf):
    """After the last message every agent is told once that nothing more has come, also those that never had one."""
    import time

    rows, known = _inboxes(spark, sf)
    silent = log(spark, sf).select(F.concat(F.lit("silent-"), "topic").alias("agent")).distinct()
    registered = known.select("agent").unionByName(silent)
    agents = registered.distinct().count()
    target = work_dir(spark, "deliveries")
    stream = stream_jobs.file_stream(spark, _files(spark, rows)[0], rows.schema)
    out = deliveries(stream, known, timeout_ms=1000, registered=registered).writeStream.format("parquet").option("path", target)
    running = out.option("checkpointLocation", work_dir(spark, "progress")).trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 600
        while True:
            if any(p["numInputRows"] > 0 for p in running.recentProgress):
                told = spark.read.parquet(target).where("status = 'timeout'").select("agent", "status").distinct()
                if told.count() >= agents:
                    return told
            if time.time() > deadline or not running.isActive:
                raise TimeoutError("not every agent has been told")
            time.sleep(0.5)
    finally:
        running.stop()


@query("t9_live_metrics", "SELECT count(*) AS items, count(*) FILTER (value > 100) AS errors, max(event_id) AS last_id FROM events")
def t9(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    path, each = _files(spark, e)
    stream = stream_jobs.file_stream(spark, path, e.schema, each)
    fed = stream_jobs.with_feed(stream, "feed", "event_id", F.col("value") > 100, F.col("event_type"))
    sink = work_dir(spark, "sink")
    q = fed.writeStream.format("parquet").option("path", sink).option("checkpointLocation", work_dir(spark, "progress"))
    feeds = stream_jobs.Feeds("feed")
    spark.streams.addListener(feeds)
    found = feeds.collected(spark, q.trigger(availableNow=True).start())
    rows = [(f["items"], f["errors"], f["last"]["event_id"]) for f in found]
    per_batch = spark.createDataFrame(rows, "items long, errors long, last_id long")
    return per_batch.agg(F.sum("items").alias("items"), F.sum("errors").alias("errors"), F.max("last_id").alias("last_id"))


@query("k18_periodic_save", "SELECT id, category, 3 AS saves FROM (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'other' WHEN quality = 1 THEN 'useful' ELSE 'unknown' END AS category FROM labels)")
def k18(spark, sf):
    rows = inputs.categories(spark, sf)
    store = _store(spark)

    def process(df):
        return df.select("id", F.struct("category").alias("value"), F.lit(None).cast("string").alias("error"))

    job = stream_jobs.PolledJob(store, "saved", "id", [F.col("category")], process)
    _run(job, spark, _files(spark, rows), rows.schema)
    return store.read("saved").withColumn("saves", F.lit(store._latest()[0]).cast("int"))


@query(
    "k18_saves_by_rows",
    """SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'other' WHEN quality = 1 THEN 'useful' ELSE 'unknown' END AS category,
       CAST((SELECT ceil(count(*) / 100.0) FROM labels) AS INT) AS saves FROM labels""",
)
def k18_rows(spark, sf):
    """All rows arrive at once; they are saved by hundreds."""
    rows = inputs.categories(spark, sf)
    store = _store(spark)

    def process(df):
        return df.select("id", F.struct("category").alias("value"), F.lit(None).cast("string").alias("error"))

    job = stream_jobs.PolledJob(store, "saved", "id", [F.col("category")], process, save_every=100)
    job.finish(job.start(stream_jobs.file_stream(spark, _files(spark, rows)[0], rows.schema), work_dir(spark, "progress")))
    return store.read("saved").withColumn("saves", F.lit(job.saves).cast("int"))
