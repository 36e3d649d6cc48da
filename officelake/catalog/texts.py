"""Bindings: mail, HTML and markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from officelake.catalog import query
from officelake.functions import html, mail, markdown
from officelake.operators import elements, rendering
from officelake.plans import inputs
from officelake.plans.inputs import MAIL_SQL, table


def _raw(spark, sf):
    """Messages as RFC 822 bytes: html from assistants, base64-encoded text from users."""
    m = inputs.as_mail(inputs.texts(spark, sf, "conversations"))
    html_part = F.concat(F.lit("<html><body><p>"), F.col("body"), F.lit("</p></body></html>"))
    encoding = F.when(F.col("role") == "user", "base64").otherwise("8bit")
    kind = F.when(F.col("role") == "assistant", "html").otherwise("plain")
    body = F.when(F.col("role") == "assistant", html_part).otherwise(F.col("body"))
    content = F.when(F.col("role") == "user", F.base64(F.encode(body, "UTF-8"))).otherwise(body)
    head = F.concat(
        F.lit("From: "), "senders", F.lit("\r\nX-Id: "), "id", F.lit("\r\nMIME-Version: 1.0\r\nContent-Type: text/"), kind,
        F.lit('; charset="utf-8"\r\nContent-Transfer-Encoding: '), encoding, F.lit("\r\n\r\n"),
    )
    return m.select("id", "role", F.encode(F.concat(head, content), "UTF-8").alias("raw"))


@query(
    "x1_mail_parse",
    f"""WITH {MAIL_SQL} SELECT id, senders AS sender, CASE WHEN role = 'assistant' THEN 'text/html' ELSE 'text/plain' END AS body_type,
        CASE WHEN role = 'assistant' THEN '<html><body><p>' || body || '</p></body></html>' ELSE body END AS body, CAST(NULL AS VARCHAR) AS error FROM mail""",
)
def x1(spark, sf):
    from officelake.operators.filters import header_value

    p = _raw(spark, sf).select("id", mail.parse_mail(F.col("raw")).alias("p"))
    return p.select("id", header_value(F.col("p.headers"), "from").alias("sender"), "p.body_type", "p.body", "p.error")


@query(
    "x2_main_body",
    f"""WITH {MAIL_SQL} SELECT thread_id AS id, CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'text/html' ELSE 'text/plain' END AS body_type,
        CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN arg_min(body, turn) FILTER (role = 'assistant')
             ELSE arg_max(body, turn) FILTER (role = 'user') END AS body FROM mail WHERE role <> 'system' GROUP BY 1""",
)
def x2(spark, sf):
    m = inputs.mail(spark, sf)
    kind = F.when(F.col("role") == "assistant", "text/html").when(F.col("role") == "user", "Text/Plain").otherwise("image/png")
    parts = m.select(
        F.col("thread_id").alias("id"), F.col("turn").alias("part_no"), kind.alias("mime_type"), F.col("body").alias("content"),
        F.lit(False).alias("is_attachment"),
    )
    return mail.choose_body(parts).select("id", F.lower("body_type").alias("body_type"), "body")


CLEAN_SQL = html.clean_sql("html")
MARKDOWN_SQL = html.sql_steps(html.sql_steps("html", html.CLEAN_STEPS), html.MARKDOWN_STEPS)


@query(
    "x3_mail_content_markdown",
    f"""WITH {MAIL_SQL}, raw AS (SELECT id, CASE WHEN role = 'assistant' THEN '<html><body><p>' || body || '</p></body></html>' ELSE body END AS html FROM mail)
        SELECT id, {MARKDOWN_SQL} AS value, CAST(NULL AS VARCHAR) AS error FROM raw""",
)
def x3(spark, sf):
    out = _raw(spark, sf).select("id", mail.mail_content(F.col("raw"), "md").alias("c"))
    return out.select("id", "c.value", "c.error")


#: A stack of open tags is carried along each page, one token a step; what an element holds follows from where it is open.
PAGES_SQL = """WITH RECURSIVE tokens AS MATERIALIZED (
  SELECT page_id, i, t, CASE WHEN t LIKE '<!--%' OR t ILIKE '<script%' OR t ILIKE '<style%' THEN 'gone' WHEN t LIKE '<!%' THEN 'mark'
      WHEN t LIKE '</%' THEN 'close' WHEN regexp_matches(t, '^<(br|meta|img|hr)[ />]') THEN 'void' WHEN t LIKE '<_%' THEN 'open' ELSE 'text' END AS kind,
    regexp_extract(t, '^</?([a-z][a-z0-9]*)', 1) AS name
  FROM (SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|[^<]+|<') AS l FROM pages))),
walk AS (
  SELECT page_id, 0::BIGINT AS i, []::STRUCT(name VARCHAR, start BIGINT)[] AS stack FROM pages
  UNION ALL
  SELECT w.page_id, t.i, CASE WHEN kind = 'open' THEN list_append(stack, {'name': t.name, 'start': t.i})
      WHEN kind = 'close' AND list_contains(list_transform(stack, lambda s: s.name), t.name)
        THEN stack[1 : len(stack) - list_position(list_reverse(list_transform(stack, lambda s: s.name)), t.name)]
      ELSE stack END
  FROM walk w JOIN tokens t ON t.page_id = w.page_id AND t.i = w.i + 1),
inside AS MATERIALIZED (SELECT w.page_id, w.i, unnest(w.stack).start AS start FROM walk w),
spans AS (
  SELECT e.page_id, e.start, max(e.i) AS last, any_value(o.name) AS name, count(*) FILTER (t.kind = 'text' AND regexp_matches(t.t, '[A-Za-z0-9]')) AS texts
  FROM inside e JOIN tokens t ON t.page_id = e.page_id AND t.i = e.i JOIN tokens o ON o.page_id = e.page_id AND o.i = e.start GROUP BY e.page_id, e.start),
ends AS MATERIALIZED (
  SELECT s.*, coalesce(c.kind = 'close' AND c.name = s.name AND s.start = (
      SELECT max(x.start) FROM spans x WHERE x.page_id = s.page_id AND x.name = s.name AND x.last = s.last), false) AS closed,
    texts = 0 AND s.name NOT IN ('head', 'body') AS dropped
  FROM spans s LEFT JOIN tokens c ON c.page_id = s.page_id AND c.i = s.last + 1),
gone AS (SELECT page_id, start, last + closed::INT AS last FROM ends WHERE dropped),
shown AS (
  SELECT page_id, i, 1 AS own, 0 AS back, regexp_replace(t, ' class="[^"]*"', '') AS t FROM tokens k
  WHERE kind IN ('text', 'open', 'mark') OR kind = 'close' AND EXISTS (SELECT 1 FROM ends e WHERE e.page_id = k.page_id AND e.last + 1 = k.i AND e.closed)
  UNION ALL SELECT page_id, last + 1, 0, -start, '</' || name || '>' FROM ends WHERE NOT closed AND NOT dropped),
kept AS (SELECT * FROM shown s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.page_id = s.page_id AND g.start <= s.i AND s.i <= g.last)),
clean AS (SELECT page_id, string_agg(t, '' ORDER BY i, own, back) AS html FROM kept GROUP BY page_id)"""


@query("x4_html_clean", f"{PAGES_SQL} SELECT page_id, coalesce(clean.html, '') AS html FROM pages LEFT JOIN clean USING (page_id)")
def x4(spark, sf):
    return elements.clean_pages(inputs.texts(spark, sf, "pages"), "page_id", "html", "html")


@query("x4_html_stripped", f"SELECT page_id, {CLEAN_SQL} AS html FROM pages")
def x4_stripped(spark, sf):
    """Only comments, scripts, styles and layout attributes taken out, as a column."""
    return inputs.texts(spark, sf, "pages").select("page_id", html.clean(F.col("html")).alias("html"))


#: The cleaned page cut at its block tags, which in these pages never lie in inline ones; texts and inline tags by turns.
RENDERED_SQL = f"""{PAGES_SQL},
pieces AS (
  SELECT page_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '</?(?:html|head|title|body|nav|ul|li|div|article|h1|p|footer)\\b[^>]*>(?:[^<]|</?[ab]\\b[^>]*>)*') AS l FROM clean)),
cut AS (
  SELECT page_id, i, regexp_extract(p, '^<(/?[a-z0-9]+)', 1) AS tag, regexp_replace(p, '^<[^>]*>', '') AS c FROM pieces),
inline AS (
  SELECT page_id, i, tag, list_transform(string_split_regex(c, '<[^>]*>'), lambda x: regexp_replace(regexp_replace(x, '[ \\t\\r\\n\\f]+', ' ', 'g'), '([*_])', '\\\\\\1', 'g')) AS texts,
    list_transform(regexp_extract_all(c, '<[^>]*>'), lambda x: CASE WHEN x LIKE '<a %' THEN '[' WHEN x = '</a>' THEN '](' || regexp_extract(c, 'href="([^"]*)"', 1) || ')' ELSE '**' END) AS marks FROM cut),
blocks AS (
  SELECT page_id, i, tag, trim(regexp_replace(replace(replace(replace(replace(replace(
    list_reduce(list_transform(list_zip(texts, marks), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), lambda a, b: a || b),
    '&lt;', '<'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), ' {{2,}}', ' ', 'g')) AS t FROM inline),
full_ AS (SELECT *, CASE tag WHEN 'li' THEN '* ' WHEN 'h1' THEN '# ' ELSE '' END || t AS line FROM blocks WHERE t <> ''),
parted AS (SELECT *, lag(tag) OVER (PARTITION BY page_id ORDER BY i) AS before FROM full_),
rendered AS (SELECT page_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN before = 'li' AND tag = 'li' THEN chr(10) ELSE chr(10) || chr(10) END || line, '' ORDER BY i) || chr(10) AS value
  FROM parted GROUP BY page_id)"""


@query(
    "x5_html_to_markdown",
    f"{RENDERED_SQL} SELECT page_id, value, CASE WHEN value IS NULL THEN 'the page has no text' END AS error FROM pages LEFT JOIN rendered USING (page_id)",
)
def x5(spark, sf):
    return rendering.markdown_pages(inputs.texts(spark, sf, "pages"), "page_id", "html")


@query("x5_markdown_column", f"SELECT page_id, {MARKDOWN_SQL} AS value, CAST(NULL AS VARCHAR) AS error FROM pages")
def x5_column(spark, sf):
    """The same by string steps, as a column: without nesting, and with what cleaning would take out."""
    out = inputs.texts(spark, sf, "pages").select("page_id", html.document_markdown(F.col("html")).alias("m"))
    return out.select("page_id", "m.value", "m.error")


@query(
    "x6_format_conversion",
    f"""SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN {MARKDOWN_SQL} WHEN url LIKE '%/de/%' THEN {CLEAN_SQL} END AS value,
        CASE WHEN url NOT LIKE '%/en/%' AND url NOT LIKE '%/de/%' THEN 'no way from text/html to text/plain' END AS error FROM pages""",
)
def x6(spark, sf):
    url = F.col("url")
    target = F.when(url.contains("/en/"), "text/markdown").when(url.contains("/de/"), "text/x-clean-html").otherwise("text/plain")
    out = inputs.texts(spark, sf, "pages").select("page_id", html.convert(F.col("html"), F.lit("text/html"), target).alias("c"))
    return out.select("page_id", "c.value", "c.error")


@query(
    "x3_mail_rendered",
    f"""WITH {MAIL_SQL} SELECT id, CASE WHEN role = 'assistant' THEN trim(regexp_replace(regexp_replace(body, '[ \\t\\r\\n\\f]+', ' ', 'g'), '([*_])', '\\\\\\1', 'g')) || chr(10) ELSE body END AS value,
        CAST(NULL AS VARCHAR) AS error FROM mail""",
)
def x3_rendered(spark, sf):
    """Bodies of mails: html rendered as a page is, plain text as it is."""
    return rendering.mail_bodies(_raw(spark, sf), "id", "raw")


@query(
    "x6_pages_converted",
    f"""{RENDERED_SQL} SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN value WHEN url LIKE '%/de/%' THEN coalesce(clean.html, '') END AS value,
        CASE WHEN url NOT LIKE '%/en/%' AND url NOT LIKE '%/de/%' THEN 'no way from text/html to text/plain' END AS error
        FROM pages LEFT JOIN rendered USING (page_id) LEFT JOIN clean USING (page_id)""",
)
def x6_converted(spark, sf):
    """Pages rendered, cleaned, or neither, by what their language asks for."""
    url = F.col("url")
    target = F.when(url.contains("/en/"), "text/markdown").when(url.contains("/de/"), "text/x-clean-html").otherwise("text/plain")
    return rendering.convert_pages(inputs.texts(spark, sf, "pages"), "page_id", "html", F.lit("text/html"), target)


@query(
    "x10_markdown_blocks",
    r"""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS line
            FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
        w AS (SELECT doc_id, i, regexp_extract_all(line, '[A-Za-z]+') AS words FROM l),
        t AS (SELECT doc_id, i, array_to_string(words, ' ') AS t, length(words[1]) AS first FROM w WHERE len(words) > 0)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS block_no,
          CASE WHEN i % 4 = 0 THEN 'heading' WHEN i % 4 = 1 THEN 'list_item' WHEN i % 4 = 2 THEN 'indented' ELSE 'paragraph' END AS kind,
          CAST(CASE WHEN i % 4 = 0 THEN 2 WHEN i % 4 = 2 THEN 3 ELSE 0 END AS INT) AS level, t AS text,
          CASE WHEN i % 4 = 3 THEN '0-' || first || ' strong' ELSE '' END AS spans FROM t""",
)
def x10(spark, sf):
    """Lines of documents dressed as markdown blocks in turn: heading, item, indented and bold paragraph."""
    d = inputs.texts(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))

    def dressed(line, i):
        words = F.regexp_extract_all(line, F.lit("([A-Za-z]+)"), 1)
        text = F.array_join(words, " ")
        bold = F.concat(F.lit("**"), words[0], F.lit("**"), F.expr("''"))
        rest = F.array_join(F.slice(words, 2, 1 << 30), " ")
        strong = F.concat(bold, F.when(F.size(words) > 1, F.concat(F.lit(" "), rest)).otherwise(""))
        block = (
            F.when(i % 4 == 0, F.concat(F.lit("## "), text))
            .when(i % 4 == 1, F.concat(F.lit("* "), text))
            .when(i % 4 == 2, F.concat(F.lit("... "), text))
            .otherwise(strong)
        )
        return F.when(F.size(words) > 0, block)

    source = d.select("doc_id", F.array_join(F.transform("lines", dressed), "\n\n").alias("md"))
    out = markdown.block_rows(source, "md")
    spans = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(" "), s["style"]))
    return out.select("doc_id", "block_no", "kind", "level", "text", F.array_join(spans, ";").alias("spans"))


@query(
    "x10_markdown_marks",
    r"""WITH l AS (SELECT doc_id, i, regexp_extract_all(string_split(text, chr(10))[i + 1], '[A-Za-z]+') AS w
            FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
        t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, w[1] AS a, w[2] AS b FROM l WHERE len(w) > 1)
        SELECT doc_id, CAST(n AS INT) AS block_no, 'list_item' AS kind, CAST(n % 3 AS INT) AS level, a || ' ' || b AS text,
          CASE WHEN n % 2 = 0 THEN '0-' || (length(a) + 1 + length(b)) || ' strong;' || (length(a) + 1) || '-' || (length(a) + 1 + length(b)) || ' em'
               ELSE '0-' || length(a) || ' code;' || (length(a) + 1) || '-' || (length(a) + 1 + length(b)) || ' strike' END AS spans FROM t""",
)
def x10_marks(spark, sf):
    """Lines of documents as items of three depths, their first two words marked within and beside each other."""
    words = F.transform(F.split("text", "\n"), lambda line: F.regexp_extract_all(line, F.lit("([A-Za-z]+)"), 1))
    d = inputs.texts(spark, sf, "documents").select("doc_id", F.filter(words, lambda w: F.size(w) > 1).alias("lines"))

    def dressed(w, n):
        nested = F.concat(F.lit("**"), w[0], F.lit(" *"), w[1], F.lit("***"))
        beside = F.concat(F.lit("`"), w[0], F.lit("` ~~"), w[1], F.lit("~~"))
        return F.concat(F.repeat(F.lit("    "), n % 3), F.lit("- "), F.when(n % 2 == 0, nested).otherwise(beside))

    out = markdown.block_rows(d.select("doc_id", F.array_join(F.transform("lines", dressed), "\n").alias("md")), "md")
    spans = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(" "), s["style"]))
    return out.select("doc_id", "block_no", "kind", "level", "text", F.array_join(spans, ";").alias("spans"))


@query(
    "f1_decode_header",
    """SELECT conv_id, turn, nullif(CASE WHEN role = 'user' THEN 'Re: ' || text WHEN role = 'system' THEN '' ELSE text END, '') AS subject FROM conversations""",
)
def f1(spark, sf):
    encoded = F.concat(F.lit("Re: =?utf-8?b?"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", ""), F.lit("?="))
    raw = F.when(F.col("role") == "user", encoded).when(F.col("role") == "system", "").otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", mail.decode_header(raw).alias("subject"))
