"""Bindings: filters, projections, joins, aggregates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from officelake.catalog import query
from officelake.operators import aggregates, filters, lookups, ordering
from officelake.plans import inputs
from officelake.plans.inputs import CATEGORIES_SQL, ITEMS_SQL, MAIL_SQL, TASKS_SQL, table


def _documents(spark, sf):
    return table(spark, sf, "documents").withColumnRenamed("doc_id", "id")


@query(
    "p1_unprocessed",
    "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def p1(spark, sf):
    done = inputs.categories(spark, sf)
    return filters.unprocessed(_documents(spark, sf), done).select("id", "lang")


@query("p2_force_all", "SELECT doc_id AS id, lang FROM documents")
def p2(spark, sf):
    done = inputs.categories(spark, sf)
    return filters.unprocessed(_documents(spark, sf), done, force_all=True).select("id", "lang")


def _placements(items):
    placed = items.where((F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "F"))
    return placed.select(
        "analysis_id",
        "action_number",
        F.when(F.col("l_linestatus") == "F", "doc-1").otherwise("doc-2").alias("placement_container_url"),
        F.when(F.col("l_returnflag") == "N", "p7").otherwise("(None)").alias("placement_id"),
    )


@query(
    "p3_unplaced",
    f"""WITH {ITEMS_SQL}, own AS (SELECT *, CASE WHEN l_suppkey <> 1 THEN analysis_id END AS aid FROM items)
        SELECT aid AS analysis_id, action_number, title FROM own
        WHERE aid IS NOT NULL AND NOT (l_linestatus = 'F' AND l_returnflag <> 'N')""",
)
def p3(spark, sf):
    items = inputs.action_items(spark, sf)
    own = items.withColumn("analysis_id", F.when(F.col("l_suppkey") != 1, F.col("analysis_id")))
    return filters.unplaced(own, _placements(items), "doc-1").select("analysis_id", "action_number", "title")


@query(
    "p4_priority_match",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '^(?i:1-urg|2-h)')",
)
def p4(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.where(filters.matches_priority("1-urg|2-h", "o_orderpriority")).select("o_orderkey", "o_orderpriority")


@query("p5_remove_none", f"WITH {ITEMS_SQL} SELECT analysis_id, action_number, notes FROM items WHERE notes IS NOT NULL")
def p5(spark, sf):
    items = inputs.action_items(spark, sf).select("analysis_id", "action_number", "notes")
    return filters.remove_none(items, "notes")


@query(
    "p6_remove_none_values",
    """SELECT event_id, '{"type":"' || event_type || '"' || CASE WHEN value > 50 THEN ',"big":' || user_id ELSE '' END
          || ',"tags":[' || CASE WHEN event_type <> 'view' THEN '"' || event_type || '",' ELSE '' END || '"end"]'
          || ',"extra":{' || CASE WHEN value > 50 THEN '"user":"' || user_id || '"' ELSE '' END || '}}' AS body
       FROM events""",
)
def p6(spark, sf):
    e = table(spark, sf, "events")
    big = F.when(F.col("value") > 50, F.col("user_id"))
    rows = e.select(
        "event_id",
        F.col("event_type").alias("type"),
        big.alias("big"),
        F.array(F.when(F.col("event_type") != "view", F.col("event_type")), F.lit("end")).alias("tags"),
        F.create_map(F.lit("user"), big.cast("string")).alias("extra"),
    )
    return rows.select("event_id", filters.payload(rows, ["type", "big", "tags", "extra"]).alias("body"))


@query(
    "p7_managed_only",
    f"WITH {TASKS_SQL} SELECT id, 'http://t/' || id AS id_url FROM tasks WHERE notes LIKE chr(128279) || '%'",
)
def p7(spark, sf):
    from officelake.sources.tasks import managed_tasks

    return managed_tasks(inputs.tasks(spark, sf)).select("id", "id_url")


@query(
    "p8_refine_routing",
    f"""WITH {CATEGORIES_SQL} SELECT id, category,
        CASE WHEN category IN ('unknown','other') THEN 'refined' ELSE 'kept' END AS route FROM categories""",
)
def p8(spark, sf):
    rows = inputs.categories(spark, sf).withColumn("route", F.lit("kept"))
    return filters.route(rows, "category", ["unknown", "other"], lambda d: d.withColumn("route", F.lit("refined")))


HEADERS_SQL = """'Subject: ' || subject || chr(10) || 'From: ' || senders
        || CASE WHEN role = 'user' THEN chr(10) || 'To: assistant@example.com' ELSE '' END
        || chr(10) || 'Received: ' || received_date"""


def email_metadata():
    """Header lines of a message as the model sees them."""
    to = F.when(F.col("role") == "user", "assistant@example.com")
    nothing = F.lit(None).cast("string")
    return filters.header_lines(
        Subject=F.col("subject"), From=F.col("senders"), To=to, Cc=nothing, Bcc=nothing, Received=F.col("received_date")
    )


@query("p9_prompt_inputs", f"WITH {MAIL_SQL} SELECT id, {HEADERS_SQL} AS email_metadata, body AS email_content FROM mail")
def p9(spark, sf):
    mail = inputs.mail(spark, sf)
    return mail.select("id", email_metadata().alias("email_metadata"), F.col("body").alias("email_content"))


@query(
    "p12_computed_urls",
    f"""WITH {ITEMS_SQL} SELECT analysis_id, action_number, analysis_id || '#' || action_number AS source_url FROM items""",
)
def p12(spark, sf):
    items = inputs.action_items(spark, sf)
    url = filters.numbered_url(F.col("analysis_id"), F.col("action_number"))
    return items.select("analysis_id", "action_number", url.alias("source_url"))


@query("p13_header_lookup", f"WITH {MAIL_SQL} SELECT id, subject, CAST(NULL AS VARCHAR) AS cc FROM mail")
def p13(spark, sf):
    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    headers = F.array(
        header("From", F.col("senders")), header("SUBJECT", F.col("subject")), header("subject", F.lit("second"))
    )
    mail = inputs.mail(spark, sf).select("id", headers.alias("h"))
    return mail.select(
        "id",
        filters.header_value(F.col("h"), "Subject").alias("subject"),
        filters.header_value(F.col("h"), "Cc").alias("cc"),
    )


@query(
    "j1_pending_anti_join",
    f"""WITH {MAIL_SQL} SELECT id, received_date FROM mail m
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = m.thread_id)""",
)
def j1(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("thread_id"))
    return filters.unprocessed(inputs.mail(spark, sf), done, "thread_id").select("id", "received_date")


@query(
    "j2_composite_anti_join",
    f"""WITH {ITEMS_SQL} SELECT analysis_id, action_number FROM items
        WHERE NOT (l_linestatus = 'O' AND l_returnflag = 'R')""",
)
def j2(spark, sf):
    items = inputs.action_items(spark, sf)
    return filters.unplaced(items, _placements(items), "doc-2").select("analysis_id", "action_number")


@query(
    "j3_match_back",
    """WITH answers AS (SELECT CASE WHEN quality = 0 THEN doc_id + 10000000 ELSE doc_id END AS id, toxic FROM labels)
       SELECT 'matched' AS kind, d.doc_id AS id, a.toxic FROM documents d JOIN answers a ON a.id = d.doc_id
       UNION ALL SELECT 'unknown', a.id, a.toxic FROM answers a WHERE a.id NOT IN (SELECT doc_id FROM documents)""",
)
def j3(spark, sf):
    answers = table(spark, sf, "labels").select(
        F.when(F.col("quality") == 0, F.col("doc_id") + 10000000).otherwise(F.col("doc_id")).alias("id"), "toxic"
    )
    matched, unknown = lookups.match_back(answers, _documents(spark, sf))
    return matched.select(F.lit("matched").alias("kind"), "id", "toxic").unionByName(
        unknown.select(F.lit("unknown").alias("kind"), "id", "toxic")
    )


@query(
    "j4_source_with_analysis",
    f"WITH {CATEGORIES_SQL} SELECT d.doc_id AS id, d.source, c.category FROM documents d LEFT JOIN categories c ON c.id = d.doc_id",
)
def j4(spark, sf):
    return _documents(spark, sf).join(inputs.categories(spark, sf), "id", "left").select("id", "source", "category")


@query(
    "j5_children_in_order",
    f"""WITH {ITEMS_SQL} SELECT o_orderkey AS analysis_id,
        coalesce(string_agg(title, ',' ORDER BY action_number), '') AS titles
        FROM orders LEFT JOIN items ON analysis_id = o_orderkey GROUP BY o_orderkey""",
)
def j5(spark, sf):
    parents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("analysis_id"))
    children = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "analysis_id")
    title = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    out = lookups.attach_children(
        parents, children, "analysis_id", [F.col(c) for c in inputs.LINE_ORDER], title, "titles"
    )
    return out.withColumn("titles", F.array_join("titles", ","))


@query(
    "j6_subtype_join",
    """SELECT c_custkey AS id, c_name, o_orderkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END AS balance
       FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')""",
)
def j6(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_mktsegment").alias("type"))
    detail = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    both = lookups.subtype(base, orders, "type", "MACHINERY").unionByName(
        lookups.subtype(base, orders, "type", "BUILDING")
    )
    wide = lookups.polymorphic(both, "type", {"MACHINERY": detail})
    return wide.select("id", "c_name", "o_orderkey", F.col("MACHINERY.c_acctbal").alias("balance"))


@query(
    "j7_many_to_one_chain",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate, c_name FROM lineitem
       LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey""",
)
def j7(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    out = li.join(orders, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = out.join(customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.drop("o_orderkey", "o_custkey", "c_custkey")


@query(
    "j8_query_per_row",
    """SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 50""",
)
def j8(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    out = lookups.query_per_row(
        customer,
        orders,
        lambda c, o: (o["o_custkey"] == c["c_custkey"]) & (o["o_totalprice"] > c["c_acctbal"] * 50),
    )
    return out.select("c_custkey", "o_orderkey")


@query(
    "j8_overlap",
    """WITH e AS (SELECT event_id, epoch_us(ts) AS start, epoch_us(ts) + CAST(floor(value * 2000000) AS BIGINT) AS stop FROM events)
       SELECT a.event_id, count(*) AS met, max(b.event_id) AS last FROM e a JOIN e b ON a.start <= b.stop AND b.start <= a.stop GROUP BY 1""",
)
def j8_overlap(spark, sf):
    """Events last as long as their value says: how many others each one meets."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf, "events").select("event_id", start.alias("start"), (start + F.floor(F.col("value") * 2_000_000)).alias("stop"))
    met = lookups.interval_join(e, e, ("start", "stop"), ("start", "stop"), width=1_000_000, last_of="event_id")
    return met.groupBy("left.event_id").agg(F.sum("met").alias("met"), F.max("last").alias("last"))


@query(
    "j9_first_match",
    """SELECT o_orderpriority AS ext, arg_min(o_orderkey, (o_custkey, o_orderkey)) AS id, min(o_custkey) AS tasklist_id
       FROM orders GROUP BY o_orderpriority""",
)
def j9(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("ext"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tasklist_id")
    )
    return lookups.first_match(orders, "ext", [F.col("tasklist_id"), F.col("id")])


@query(
    "j10_unique_lookup",
    "SELECT split_part(text, chr(10), 1) AS name, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING count(*) = 1",
)
def j10(spark, sf):
    d = table(spark, sf, "documents").select(F.substring_index("text", "\n", 1).alias("name"), "doc_id")
    return lookups.unique_match(d, "name")


@query(
    "j12_key_overlay",
    """SELECT coalesce(p_partkey, l_partkey) AS partkey, coalesce(top, p_retailprice) AS value
       FROM part FULL JOIN (SELECT l_partkey, max(l_extendedprice) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) t
       ON l_partkey = p_partkey""",
)
def j12(spark, sf):
    base = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_retailprice").alias("value"))
    returned = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    top = returned.groupBy(F.col("l_partkey").alias("partkey")).agg(F.max("l_extendedprice").alias("value"))
    return lookups.overlay(base, top, "partkey", "value")


@query(
    "j12_map_overlay",
    """SELECT p_partkey, p_brand AS brand, CASE WHEN p_size > 25 THEN 'large' ELSE p_type END AS kind FROM part""",
)
def j12_maps(spark, sf):
    p = table(spark, sf, "part")
    base = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))
    none = F.create_map().cast("map<string,string>")
    top = F.when(F.col("p_size") > 25, F.create_map(F.lit("kind"), F.lit("large"))).otherwise(none)
    m = p.select("p_partkey", lookups.overlay_maps(base, top).alias("m"))
    return m.select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["kind"].alias("kind"))


@query(
    "a1_last_wins",
    """SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_partkey,
       arg_max(l_returnflag, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_returnflag
       FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
def a1(spark, sf):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *order)
    out = ordering.last_wins(li, ["l_orderkey", "l_linenumber"], [F.col(c) for c in order])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query(
    "a2_to_list",
    f"""WITH {ITEMS_SQL} SELECT analysis_id,
        string_agg(l_linenumber || ':' || l_suppkey, ' ' ORDER BY action_number) AS edits
        FROM items GROUP BY analysis_id""",
)
def a2(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "analysis_id")
    item = F.concat_ws(":", "l_linenumber", "l_suppkey")
    out = ordering.ordered_lists(li, ["analysis_id"], [F.col(c) for c in inputs.LINE_ORDER], item, name="edits")
    return out.withColumn("edits", F.array_join("edits", " "))


@query(
    "a3_buffer_with_count",
    """WITH n AS (SELECT conv_id || '-' || turn AS id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations)
       SELECT i // 7 AS batch, string_agg(id, ',' ORDER BY i) AS ids FROM n GROUP BY 1""",
)
def a3(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    out = ordering.batches(c, [F.col("conv_id"), F.col("turn")], 7)
    ids = F.transform("items", lambda i: F.concat_ws("-", i["conv_id"], i["turn"]))
    return out.select("batch", F.array_join(ids, ",").alias("ids"))


@query(
    "a4_categorise_batches",
    f"""WITH {MAIL_SQL}, n AS (
          SELECT id, row_number() OVER (ORDER BY coalesce(CASE WHEN role <> 'system' THEN received_date END, ''), id) - 1 AS i FROM mail)
        SELECT i // 20 AS batch, count(*) AS size, string_agg(id, ',' ORDER BY i) AS ids FROM n GROUP BY 1""",
)
def a4(spark, sf):
    mail = inputs.mail(spark, sf).select("id", F.when(F.col("role") != "system", F.col("received_date")).alias("received_date"))
    out = ordering.batches(mail, [F.coalesce("received_date", F.lit("")), F.col("id")], 20)
    return out.select(
        "batch",
        F.size("items").cast("long").alias("size"),
        F.array_join(F.transform("items", lambda i: i["id"]), ",").alias("ids"),
    )


@query(
    "a5_stream_statistics",
    """WITH s AS (SELECT event_type, count(*) AS items, count(*) FILTER (value > 100) AS errors,
                         arg_max(props, event_id) AS last_sample FROM events GROUP BY 1),
            t AS (SELECT DISTINCT event_type FROM (SELECT event_type FROM events UNION ALL SELECT 'never-' || event_type FROM events))
       SELECT event_type, coalesce(items, 0) AS items, coalesce(errors, 0) AS errors, last_sample
       FROM t LEFT JOIN s USING (event_type)""",
)
def a5(spark, sf):
    e = table(spark, sf, "events")
    touched = e.select("event_type").unionByName(e.select(F.concat(F.lit("never-"), "event_type").alias("event_type")))
    return aggregates.stream_statistics(
        e, "event_type", F.col("value") > 100, F.col("props"), F.col("event_id"), touched
    )


@query(
    "a7_processed_ids",
    f"""WITH {ITEMS_SQL}, done AS (SELECT DISTINCT analysis_id || '|' || action_number AS id FROM items WHERE l_returnflag <> 'N')
        SELECT 'processed' AS kind, id AS origin_id FROM done UNION ALL
        SELECT 'missing', id FROM (SELECT DISTINCT analysis_id || '|' || action_number AS id FROM items)
        WHERE id NOT IN (SELECT id FROM done)""",
)
def a7(spark, sf):
    items = inputs.action_items(spark, sf).select(
        F.concat_ws("|", "analysis_id", "action_number").alias("origin_id"), "l_returnflag"
    )
    edits = items.where(F.col("l_returnflag") != "N").select(F.array("origin_id").alias("origin_ids"))
    done = aggregates.id_union(edits)
    missing = aggregates.missing_ids(items, done)
    return done.select(F.lit("processed").alias("kind"), "origin_id").unionByName(
        missing.select(F.lit("missing").alias("kind"), "origin_id")
    )


@query("w1_child_ordinal", f"WITH {ITEMS_SQL} SELECT analysis_id, action_number, l_partkey FROM items")
def w1(spark, sf):
    return inputs.action_items(spark, sf).select("analysis_id", "action_number", "l_partkey")


@query(
    "w2_every_nth_sample",
    """SELECT event_id, event_type FROM (
         SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn % 10 = 0""",
)
def w2(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return ordering.every_nth(e, ["event_type"], [F.col("event_id")], 10)


@query(
    "l1_order_by_date_id",
    f"WITH {MAIL_SQL} SELECT id, received_date, row_number() OVER (ORDER BY coalesce(received_date, ''), id) - 1 AS place FROM mail",
)
def l1(spark, sf):
    mail = inputs.mail(spark, sf).select("id", "received_date")
    return ordering.global_index(mail, [F.coalesce("received_date", F.lit("")), F.col("id")], "place")


@query(
    "l2_take_after_filter",
    """SELECT doc_id AS id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       ORDER BY n_chars DESC, doc_id LIMIT 30""",
)
def l2(spark, sf):
    pending = filters.unprocessed(_documents(spark, sf), inputs.categories(spark, sf)).select("id", "n_chars")
    return pending.orderBy(F.col("n_chars").desc(), "id").limit(30)


@query("l4_max_results", f"WITH {MAIL_SQL} SELECT id FROM mail ORDER BY received_date, id LIMIT 250")
def l4(spark, sf):
    return inputs.mail(spark, sf).orderBy("received_date", "id").limit(250).select("id")


@query(
    "u1_rows_of_all",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT p_partkey, p_name, NULL FROM part""",
)
def u1(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return aggregates.rows_of_all(customers, suppliers, parts)


@query(
    "u2_id_difference",
    "SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'",
)
def u2(spark, sf):
    placed = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("id"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).subtract(placed)


@query(
    "u3_allowed_glob_hits",
    r"""SELECT DISTINCT url FROM pages WHERE regexp_matches(url, '^(?:.*?)?/en/[^/]*$')
        AND url IN (SELECT url FROM pages WHERE contains(html, 'article'))""",
)
def u3(spark, sf):
    from officelake.sources.files import glob_filter

    pages = table(spark, sf, "pages")
    allowed = pages.where(F.col("html").contains("article")).select("url")
    return glob_filter(pages.select("url"), "url", "**/en/*").intersect(allowed)


@query(
    "u4_key_union",
    """SELECT event_id, CASE WHEN value > 50 THEN 'k,user' ELSE 'k' END AS keys FROM events""",
)
def u4(spark, sf):
    e = table(spark, sf, "events")
    base = F.json_object_keys("props")
    none = F.array().cast("array<string>")
    top = F.when(F.col("value") > 50, F.array(F.lit("user"), F.lit("k"))).otherwise(none)
    return e.select("event_id", F.array_join(F.array_sort(F.array_union(base, top)), ",").alias("keys"))


@query(
    "u5_edit_stream_union",
    """SELECT 'delete' AS kind, l_orderkey AS doc_id, CAST(l_partkey AS BIGINT) AS index, CAST(l_partkey + l_linenumber AS BIGINT) AS end, CAST(NULL AS VARCHAR) AS content
         FROM lineitem WHERE l_returnflag = 'R'
       UNION ALL SELECT 'insert', l_orderkey, l_partkey, NULL, l_linestatus FROM lineitem WHERE l_returnflag <> 'R'""",
)
def u5(spark, sf):
    li = table(spark, sf, "lineitem")
    place = [F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("index")]
    deletes = li.where(F.col("l_returnflag") == "R").select(
        F.lit("delete").alias("kind"), *place, (F.col("l_partkey") + F.col("l_linenumber")).alias("end")
    )
    inserts = li.where(F.col("l_returnflag") != "R").select(
        F.lit("insert").alias("kind"), *place, F.col("l_linestatus").alias("content")
    )
    return aggregates.rows_of_all(deletes, inserts)
