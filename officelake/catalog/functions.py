"""Bindings: scalar functions, JSON and templates."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from officelake.catalog import query
from officelake.catalog.relational import HEADERS_SQL, email_metadata
from officelake.functions import dates, jsons, strings, template
from officelake.plans import inputs
from officelake.plans.inputs import ITEMS_SQL, MAIL_SQL, TASKS_SQL, table


@query(
    "f2_message_id",
    f"WITH {MAIL_SQL} SELECT id, CASE WHEN role = 'system' THEN id || '@host>' ELSE id || '@host' END AS msg_id FROM mail",
)
def f2(spark, sf):
    closed = F.concat(F.lit("<"), "id", F.lit("@host>"))
    raw = F.when(F.col("role") == "system", F.concat("id", F.lit("@host>"))).otherwise(closed)
    return inputs.mail(spark, sf).select("id", strings.message_id(raw).alias("msg_id"))


@query("f3_base64url", "SELECT doc_id, md5(text) AS digest FROM documents")
def f3(spark, sf):
    encoded = F.translate(F.base64(F.encode("text", "UTF-8")), "+/", "-_")
    d = table(spark, sf, "documents").select("doc_id", encoded.alias("data"))
    return d.select("doc_id", F.md5(strings.from_base64url(F.col("data"))).alias("digest"))


@query("f4_truncate_prompt", "SELECT doc_id, md5(substr(text, 1, 20000)) AS digest, least(n_chars, 20000) AS size FROM documents")
def f4(spark, sf):
    cut = strings.truncate_prompt(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(cut).alias("digest"), F.length(cut).cast("long").alias("size")
    )


@query(
    "f5_id_url_in_notes",
    f"""WITH {TASKS_SQL} SELECT id, CASE WHEN notes LIKE chr(128279) || '%' THEN 'http://t/' || id END AS id_url,
        chr(128279) || 'http://new/' || id || chr(10) || regexp_replace(notes, '^.*\\n', '') AS notes FROM tasks""",
)
def f5(spark, sf):
    t = inputs.tasks(spark, sf)
    new = F.concat(F.lit("http://new/"), F.col("id").cast("string"))
    return t.select(
        "id",
        strings.get_id_url(F.col("notes")).alias("id_url"),
        strings.set_id_url(F.col("notes"), new).alias("notes"),
    )


@query(
    "f6_utf16_len",
    r"SELECT doc_id, length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) + 2 AS units FROM documents",
)
def f6(spark, sf):
    text = F.concat("text", F.lit("\U0001f534"))
    return table(spark, sf, "documents").select("doc_id", strings.utf16_len(text).alias("units"))


@query(
    "f7_priority_symbol",
    f"""WITH {ITEMS_SQL} SELECT analysis_id, action_number, CASE lower(priority) WHEN 'critical' THEN chr(127384)
        WHEN 'high' THEN chr(128308) WHEN 'medium' THEN chr(128309) ELSE chr(9898) END AS symbol FROM items""",
)
def f7(spark, sf):
    items = inputs.action_items(spark, sf)
    return items.select("analysis_id", "action_number", strings.priority_symbol(F.col("priority")).alias("symbol"))


@query(
    "f8_modification_id",
    f"""WITH {ITEMS_SQL} SELECT analysis_id AS doc, action_number AS number,
        CASE WHEN l_returnflag <> 'A' AND l_linestatus = 'O' THEN 'a|' || analysis_id END AS analysis_id,
        CASE WHEN l_returnflag <> 'A' AND l_linestatus = 'O' THEN CAST(action_number AS INT) END AS action_number,
        CASE WHEN l_returnflag <> 'A' AND l_linestatus = 'O' THEN '(None)' END AS placement_id FROM items""",
)
def f8(spark, sf):
    items = inputs.action_items(spark, sf)
    good = F.concat(F.lit("a|"), F.col("analysis_id").cast("string"), F.lit("|"), F.col("action_number").cast("string"))
    text = F.when(F.col("l_returnflag") == "A", F.concat(good, F.lit("x"))).when(F.col("l_linestatus") == "F", "").otherwise(good)
    out = items.select(
        F.col("analysis_id").alias("doc"), F.col("action_number").alias("number"), strings.split_modification_id(text).alias("p")
    )
    return out.select("doc", "number", "p.*")


@query(
    "f9_assignments",
    r"""WITH q AS (SELECT page_id, CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS q FROM pages),
        v AS (SELECT page_id, q, nullif(regexp_extract(q, '(?:^|&)page=([^&]*)', 1), '') AS page,
              CASE WHEN contains(q, 'ref=') THEN regexp_extract(q, '(?:^|&)ref=([^&]*)', 1) END AS ref,
              list_sort(list_filter(list_transform(string_split(q, '&'), lambda p: split_part(p, '=', 1)),
                        lambda k: k NOT IN ('page', 'ref', ''))) AS unknown FROM q)
        SELECT page_id, CASE WHEN len(unknown) = 0 THEN CAST(page AS INT) END AS page, CASE WHEN len(unknown) = 0 THEN ref END AS ref,
               CASE WHEN len(unknown) > 0 THEN 'unknown: ' || array_to_string(unknown, ',') END AS error FROM v""",
)
def f9(spark, sf):
    text = F.regexp_extract("url", r"\?([^#]*)", 1)
    r = strings.typed_assignments(text, {"page": "int", "ref": "string"})
    return table(spark, sf, "pages").select("page_id", r.alias("r")).select("page_id", "r.value.page", "r.value.ref", "r.error")


@query(
    "f11_mime_of_name",
    """SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'text/html' WHEN url LIKE '%/fr/%' THEN 'application/json' END AS mime,
       CASE WHEN url LIKE '%/en/%' THEN '.html' WHEN url LIKE '%/fr/%' THEN '.json' ELSE '' END AS extension FROM pages""",
)
def f11(spark, sf):
    base = F.md5("url")
    name = F.when(F.col("url").contains("/en/"), F.concat(base, F.lit(".HTML"))).when(
        F.col("url").contains("/fr/"), F.concat(base, F.lit(".json"))
    ).otherwise(base)
    out = table(spark, sf, "pages").select("page_id", strings.mime_from_name(name).alias("mime"))
    return out.withColumn("extension", strings.extension_from_mime(F.col("mime")))


@query("f12_escape_link", f"WITH {ITEMS_SQL} SELECT analysis_id, action_number, 'http://x/Part%20' || l_partkey AS url FROM items")
def f12(spark, sf):
    url = strings.escape_link(F.concat(F.lit("http://x/"), "title"))
    return inputs.action_items(spark, sf).select("analysis_id", "action_number", url.alias("url"))


@query(
    "d1_mail_date",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts + CASE event_type
         WHEN 'click' THEN INTERVAL '-1 hour' WHEN 'view' THEN INTERVAL '5 hours' WHEN 'signup' THEN INTERVAL '5 hours 30 minutes'
         ELSE INTERVAL '0 hours' END, '%Y-%m-%dT%H:%M:%SZ') END AS received,
       CASE WHEN event_type = 'error' THEN 'unparsable date: yesterday' END AS error FROM events""",
)
def d1(spark, sf):
    at = F.date_format("ts", "d MMM yyyy HH:mm:ss")
    zone = F.when(F.col("event_type") == "click", " +0100").when(F.col("event_type") == "view", " EST (Eastern)").when(
        F.col("event_type") == "signup", " -0530"
    ).otherwise("")
    text = F.when(F.col("event_type") == "error", "yesterday").otherwise(F.concat(F.lit("Tue, "), at, zone))
    r = table(spark, sf, "events").select("event_id", dates.mail_date(text).alias("r"))
    return r.select("event_id", F.col("r.value").alias("received"), "r.error")


@query("d2_iso_utc", "SELECT event_id, strftime(ts - INTERVAL 9 HOURS, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def d2(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.iso_utc(F.col("ts"), "Asia/Tokyo").alias("at"))


@query("d3_micros", "SELECT event_id, epoch_us(ts) AS us FROM events")
def d3(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.micros(F.col("ts")).alias("us"))


@query(
    "d4_still_valid",
    """SELECT event_id, CASE event_type WHEN 'click' THEN ts >= TIMESTAMP '2024-01-29' WHEN 'view' THEN ts >= TIMESTAMP '2024-01-10'
       ELSE true END AS valid FROM events""",
)
def d4(spark, sf):
    age = F.when(F.col("event_type") == "click", 86400).when(F.col("event_type") == "view", 20 * 86400)
    valid = dates.still_valid(F.col("ts"), F.lit("2024-01-30").cast("timestamp"), age)
    return table(spark, sf, "events").select("event_id", valid.alias("valid"))


@query(
    "n1_decode_json",
    """SELECT conv_id, turn, CASE WHEN role = 'system' OR turn >= 4 THEN NULL ELSE text END AS text,
       CASE WHEN role = 'system' THEN 'JSON is not in known format' WHEN turn >= 4 THEN 'Could not parse result.' END AS error
       FROM conversations""",
)
def n1(spark, sf):
    json = F.to_json(F.struct("text"))
    json = F.when(F.col("turn") >= 4, F.concat(F.lit("["), json, F.lit(", 7"))).otherwise(json)
    fenced = F.concat(F.lit("``` json\n"), json, F.lit("\n```\n"))
    answer = F.when(F.col("role") == "system", F.concat(F.lit("Sure: "), json)).when(F.col("role") == "user", fenced).otherwise(json)
    r = table(spark, sf, "conversations").select("conv_id", "turn", jsons.decode_json(answer).alias("r"))
    return r.select("conv_id", "turn", F.variant_get("r.value", "$.text", "string").alias("text"), "r.error")


@query(
    "n2_typed_decode",
    """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
       CASE event_type WHEN 'error' THEN 'not an object of the expected type' WHEN 'view' THEN 'missing: k' END AS error FROM events""",
)
def n2(spark, sf):
    text = F.when(F.col("event_type") == "error", F.replace("props", F.lit("{"), F.lit("["))).when(
        F.col("event_type") == "view", F.replace("props", F.lit('"k"'), F.lit('"other"'))
    ).otherwise(F.col("props"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    r = table(spark, sf, "events").select("event_id", jsons.typed(text, schema, ["k"]).alias("r"))
    return r.select("event_id", "r.value.k", "r.error")


@query(
    "n3_plain_json",
    """SELECT l_orderkey, l_linenumber, l_partkey, '{"flag":"' || l_returnflag || '","shipped":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ')
       || '","tags":[' || CASE WHEN l_returnflag = l_linestatus THEN '"' || l_returnflag || '"'
          WHEN l_returnflag < l_linestatus THEN '"' || l_returnflag || '","' || l_linestatus || '"'
          ELSE '"' || l_linestatus || '","' || l_returnflag || '"' END || ']}' AS json FROM lineitem""",
)
def n3(spark, sf):
    li = table(spark, sf, "lineitem")
    tags = F.array("l_linestatus", "l_returnflag", "l_linestatus")
    row = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("shipped"), tags.alias("tags")
    )
    kinds = {f.name: f.dataType for f in row.schema.fields}
    json = F.to_json(
        F.struct(
            jsons.plain(F.col("flag"), kinds["flag"]).alias("flag"),
            jsons.plain(F.col("shipped"), kinds["shipped"]).alias("shipped"),
            jsons.plain(F.col("tags"), kinds["tags"], as_set=True).alias("tags"),
        )
    )
    return row.select("l_orderkey", "l_linenumber", "l_partkey", json.alias("json"))


PYTHON_QUOTE_SQL = r"""'"' || array_to_string(list_transform(string_split({c}, ''), lambda c: CASE
    WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(10) THEN '\n'
    WHEN unicode(c) > 126 THEN '\u' || printf('%04x', unicode(c)) ELSE c END), '') || '"'"""


def prompt_hash_sql(column: str) -> str:
    """MD5 of the canonical text of a model call with one prompt."""
    quoted = PYTHON_QUOTE_SQL.replace("{c}", column)
    return f"""md5('{{"args": [' || {quoted} || '], "kwargs": {{"output_format": null, "schema": null}}}}')"""


@query("n4_call_hash", f"SELECT conv_id, turn, {prompt_hash_sql('text')} AS args_hash FROM conversations")
def n4(spark, sf):
    none = F.lit("null")
    key = jsons.call_hash([jsons.json_quote(F.col("text"))], {"schema": none, "output_format": none})
    return table(spark, sf, "conversations").select("conv_id", "turn", key.alias("args_hash"))


@query(
    "n8_json_list_column",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN '["' || event_type || '","' || user_id || '"]' END AS json,
       CASE WHEN event_type <> 'view' THEN user_id END AS second FROM events""",
)
def n8(spark, sf):
    value = F.when(F.col("event_type") != "view", F.array("event_type", F.col("user_id").cast("string")))
    e = table(spark, sf, "events").select("event_id", jsons.encode_list(value).alias("json"))
    back = jsons.decode_list(F.col("json"))
    return e.select("event_id", "json", F.try_element_at(back, F.lit(2)).cast("long").alias("second"))


@query(
    "n9_mail_metadata",
    f"""WITH {MAIL_SQL} SELECT id, CASE WHEN role = 'user' THEN thread_id || '/' || id || '.md' ELSE id || '.msg' END AS path,
        subject, received_date, senders FROM mail""",
)
def n9(spark, sf):
    from officelake.plans.jobs import mail_metadata

    mail = inputs.mail(spark, sf)
    path = F.when(F.col("role") == "user", F.concat("thread_id", F.lit("/"), "id", F.lit(".md")))
    out = mail_metadata(mail.withColumn("path", path))
    return out.select("id", "path", "subject", "received_date", "senders")


@query(
    "n10_payload_without_nulls",
    f"""WITH {TASKS_SQL} SELECT id, '{{"title":"' || title || '","status":"' || status || '"' ||
        CASE WHEN deleted THEN ',"deleted":true' ELSE '' END || CASE WHEN hidden THEN ',"hidden":true' ELSE '' END || '}}' AS body FROM tasks""",
)
def n10(spark, sf):
    from officelake.operators.filters import payload

    t = inputs.tasks(spark, sf)
    return t.select("id", payload(t, ["title", "status", "deleted", "hidden"]).alias("body"))


ORDER_TEMPLATE = """\
{# one text per order -#}
Order {{ order.id }} ({{ order.priority | lower }}){% if order.open %} OPEN{% elif order.price > 200000 %} BIG{% else %} done{% endif %}
{%- for line in order.lines %}
- part {{ line.part }}{% if line.flag == 'R' %} returned{% endif %}
{%- endfor %}
{{ footer | render }}{{ nothing }}
"""

LINES_SQL = f"""{ITEMS_SQL}, l AS (SELECT analysis_id, string_agg(chr(10) || '- part ' || l_partkey || CASE WHEN l_returnflag = 'R' THEN ' returned' ELSE '' END,
            '' ORDER BY action_number) AS lines FROM items GROUP BY 1)"""


@query(
    "x7_templates_in_rows",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open ' || o_orderkey || chr(10) || 'Terms: pay soon.' WHEN 'F' THEN 'done: ' || lower(o_orderpriority) END AS value,
       CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'no filter named ' || chr(39) || 'nonsense' || chr(39) END AS error FROM orders""",
)
def x7_each(spark, sf):
    """Every order is rendered by the template of its status; one of them includes a file, another one is broken."""
    from officelake.functions.template import render_each, template_files
    from officelake.session import work_dir

    folder = work_dir(spark, "templates")
    table(spark, sf, "region").limit(1).select(F.lit("Terms: pay soon.").alias("value")).coalesce(1).write.text(folder)
    files = {"terms.txt": text.rstrip("\n") for text in template_files(spark, folder).values()}
    template = (
        F.when(F.col("o_orderstatus") == "O", 'open {{ o_orderkey }}\n{{ include_file("terms.txt") }}')
        .when(F.col("o_orderstatus") == "F", "done: {{ o_orderpriority | lower }}")
        .otherwise("{{ o_orderkey | nonsense }}")
    )
    orders = table(spark, sf, "orders").select(F.struct("*").alias("order"), template.alias("template"))
    out = render_each(orders, "template", "order", files=files)
    return out.select("order.o_orderkey", "text.value", "text.error")


@query(
    "x7_template",
    f"""WITH {LINES_SQL} SELECT o_orderkey, 'Order ' || o_orderkey || ' (' || lower(o_orderpriority) || ')' ||
        CASE WHEN o_orderstatus = 'O' THEN ' OPEN' WHEN o_totalprice > 200000 THEN ' BIG' ELSE ' done' END || coalesce(lines, '')
        || chr(10) || 'by the shop for ' || o_orderkey AS text FROM orders LEFT JOIN l ON analysis_id = o_orderkey""",
)
def x7(spark, sf):
    from officelake.operators.lookups import attach_children

    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderstatus") == "O", F.lit(True)).alias("open"),
        F.col("o_totalprice").alias("price"),
    )
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "id")
    item = F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    rows = attach_children(orders, lines, "id", [F.col(c) for c in inputs.LINE_ORDER], item, "lines")
    order = F.struct("id", "priority", "open", "price", "lines")
    t = template.Template(ORDER_TEMPLATE, {"footer": "by {{ shop }} for {{ order.id }}", "shop": "the shop"})
    return rows.select(F.col("id").alias("o_orderkey"), t.render(order=order).alias("text"))


TODO_SQL = """chr(10) || CASE lower(priority) WHEN 'critical' THEN chr(127384) WHEN 'high' THEN chr(128308)
       WHEN 'medium' THEN chr(128309) ELSE chr(9898) END || ' ' || title || ' [' || chr(128231) || '](' || analysis_id || '#' || action_number || ')'
       || CASE WHEN due_date IS NULL THEN '' ELSE chr(10) || chr(10) || '. ' || chr(128197) || ' ' || due_date || chr(10) || chr(10) END
       || CASE WHEN notes IS NULL THEN '' ELSE repeat(chr(10), 3) || '. ' || notes || chr(10) || chr(10) END
       || CASE WHEN l_linenumber <> 1 THEN '' ELSE chr(10) || '. **Links**:' || chr(10) || '.. ' || chr(128279) || ' [link](http://parts/no%20' || l_partkey || ')'
               || chr(10) || '.. ' || chr(128279) || ' [supplier](http://suppliers/' || l_suppkey || ')' END
       || repeat(chr(10), 3) || '&nbsp;' || repeat(chr(10), 4)"""


@query("x8_todo_markdown", f"WITH {ITEMS_SQL} SELECT analysis_id, action_number, {TODO_SQL} AS markdown FROM items")
def x8(spark, sf):
    from officelake.plans.jobs import render_todos

    return render_todos(inputs.action_items(spark, sf)).select("analysis_id", "action_number", "markdown")


def _triage_sql(metadata: str, content: str) -> str:
    head, rest = template.TRIAGE_TEMPLATE.rstrip("\n").split("{{ categories_instructions | render }}")
    middle1, rest = rest.split("{{ action_items_instructions | render }}")
    middle2, rest = rest.split("{{ context_instructions | render }}")
    answer, rest = rest.split("{{ email_metadata }}")
    rule, _ = rest.split("{{ email_content }}")
    fixed = head + "useful or other" + middle1 + "list what to do" + middle2 + "I am Kim" + answer
    return f"'{fixed}' || {metadata} || '{rule}' || {content}"


TRIAGE_SETTINGS = {
    "categories_instructions": "useful or {{ fallback }}",
    "action_items_instructions": "list what to do",
    "context_instructions": "I am {{ name }}",
    "fallback": "other",
    "name": "Kim",
}


@query("x9_triage_prompt", f"WITH {MAIL_SQL} SELECT id, {_triage_sql('(' + HEADERS_SQL + ')', 'body')} AS prompt FROM mail")
def x9(spark, sf):
    mail = inputs.mail(spark, sf)
    return mail.select("id", template.triage_prompt(email_metadata(), F.col("body"), **TRIAGE_SETTINGS).alias("prompt"))
