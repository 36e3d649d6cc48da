"""Bindings: document sections, text rendering and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from officelake.catalog import query
from officelake.operators import edits, sections
from officelake.plans import inputs
from officelake.plans.inputs import ELEMENTS_SQL, table

# Sections as SQL: text runs are grouped by the number of headings before them, parents found per rank.
NODES_SQL = f"""{ELEMENTS_SQL},
ranked AS (SELECT *, CASE WHEN level = 'TITLE' THEN 0 WHEN level LIKE 'HEADING%' THEN CAST(right(level, 1) AS INT) ELSE 7 END AS rank FROM elements),
runs AS (SELECT *, sum(CASE WHEN rank < 7 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM ranked),
nodes AS (SELECT doc_id, min(pos) AS pos, CASE WHEN rank < 7 THEN any_value(level) ELSE 'text' END AS level, rank,
            any_value(heading_id) AS heading_id, min(start_index) AS start_index, max(end_index) AS end_index,
            string_agg(text, '' ORDER BY pos) AS text
          FROM runs GROUP BY doc_id, run, rank),
pairs AS (SELECT n.doc_id, n.pos, h.pos AS hpos, h.rank AS hrank FROM nodes n JOIN nodes h
          ON h.doc_id = n.doc_id AND h.pos < n.pos AND h.rank < n.rank),
lasts AS (SELECT doc_id, pos, hrank, max(hpos) AS hpos FROM pairs GROUP BY doc_id, pos, hrank),
above AS (SELECT * FROM lasts a WHERE NOT EXISTS (
            SELECT 1 FROM lasts b WHERE b.doc_id = a.doc_id AND b.pos = a.pos AND b.hrank < a.hrank AND b.hpos > a.hpos)),
tree AS (SELECT n.*, a.parent, coalesce(a.depth, 0) AS depth FROM nodes n LEFT JOIN (
            SELECT doc_id, pos, max(hpos) AS parent, count(*) AS depth FROM above GROUP BY doc_id, pos) a USING (doc_id, pos))"""


def _nodes(spark, sf):
    return sections.section_nodes(inputs.elements(spark, sf))


def _longs(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@query(
    "w8_section_tree",
    f"WITH {NODES_SQL} SELECT doc_id, CAST(pos AS BIGINT) AS pos, level, heading_id, start_index, end_index, CAST(parent AS BIGINT) AS parent, depth, md5(text) AS digest FROM tree",
)
def w8(spark, sf):
    out = _longs(_nodes(spark, sf), "pos", "parent", "depth").withColumn("digest", F.md5("text"))
    return out.drop("rank", "text")


EXTENTS_SQL = f"""{NODES_SQL},
extents AS (SELECT t.*, t.end_index AS subsections_start, CASE WHEN rank = 7 THEN end_index ELSE coalesce(
        (SELECT max(e.end_index) FROM tree e WHERE e.doc_id = t.doc_id AND e.pos < (
            SELECT min(f.pos) FROM tree f WHERE f.doc_id = t.doc_id AND f.pos > t.pos AND f.rank <= t.rank)),
        (SELECT max(e.end_index) FROM tree e WHERE e.doc_id = t.doc_id)) END AS subsections_end FROM tree t)"""


@query(
    "w9_section_extents",
    f"WITH {EXTENTS_SQL} SELECT doc_id, CAST(pos AS BIGINT) AS pos, level, subsections_start, subsections_end FROM extents",
)
def w9(spark, sf):
    out = sections.extents(_nodes(spark, sf))
    return _longs(out.select("doc_id", "pos", "level", "subsections_start", "subsections_end"), "pos")


@query(
    "w10_closest_marker",
    f"""WITH {ELEMENTS_SQL}, s AS (SELECT e.doc_id, e.start_index, greatest(n_chars // 2 - e.start_index, 0) AS skip, e.text
            FROM elements e JOIN documents d ON d.doc_id = e.doc_id),
        f AS (SELECT *, instr(substr(text, skip + 1), 'en') AS hit FROM s)
        SELECT doc_id, min(CASE WHEN hit > 0 THEN start_index + skip + hit - 1 END) AS index FROM f GROUP BY doc_id""",
)
def w10(spark, sf):
    runs = inputs.elements(spark, sf).withColumnRenamed("text", "content")
    starts = table(spark, sf, "documents").select("doc_id", F.expr("n_chars div 2").alias("start"))
    return sections.closest_marker(runs, starts, "en")


FOUND_SQL = """(regexp_matches(level, 'HEADING_[1-5]|text') AND regexp_matches(text, '(?s)en.*\\n'))"""


@query(
    "p14_find_sections",
    f"""WITH {NODES_SQL}, hit AS (SELECT * FROM tree WHERE {FOUND_SQL})
        SELECT h.doc_id, CAST(h.pos AS BIGINT) AS pos, h.level, h.start_index FROM hit h WHERE NOT EXISTS (
            SELECT 1 FROM above a JOIN hit g ON g.doc_id = a.doc_id AND g.pos = a.hpos WHERE a.doc_id = h.doc_id AND a.pos = h.pos)""",
)
def p14(spark, sf):
    out = sections.find_sections(_nodes(spark, sf), text=r"en.*\n", heading="HEADING_[1-5]|text")
    return _longs(out.select("doc_id", "pos", "level", "start_index"), "pos")


@query(
    "p15_find_section",
    f"""WITH {NODES_SQL},
        hit1 AS (SELECT * FROM tree WHERE regexp_matches(level, 'HEADING_[12]')),
        one AS (SELECT h.doc_id, h.pos FROM hit1 h WHERE NOT EXISTS (
            SELECT 1 FROM above a JOIN hit1 g ON g.doc_id = a.doc_id AND g.pos = a.hpos WHERE a.doc_id = h.doc_id AND a.pos = h.pos)),
        scope AS (SELECT t.* FROM tree t WHERE EXISTS (SELECT 1 FROM one o WHERE o.doc_id = t.doc_id AND o.pos = t.pos)
            OR EXISTS (SELECT 1 FROM above a JOIN one o ON o.doc_id = a.doc_id AND o.pos = a.hpos WHERE a.doc_id = t.doc_id AND a.pos = t.pos)),
        hit2 AS (SELECT * FROM scope WHERE regexp_matches(text, 'a'))
        SELECT doc_id, CAST(min(pos) AS BIGINT) AS pos, arg_min(level, pos) AS level, arg_min(start_index, pos) AS start_index FROM hit2 GROUP BY doc_id""",
)
def p15(spark, sf):
    out = sections.find_section(_nodes(spark, sf), ["HEADING_[12]//", "a"])
    return _longs(out.select("doc_id", "pos", "level", "start_index"), "pos")


@query("p16_outline", f"WITH {NODES_SQL} SELECT doc_id, CAST(pos AS BIGINT) AS pos, level, text FROM tree WHERE level <> 'text'")
def p16(spark, sf):
    return _longs(sections.outline(_nodes(spark, sf)).select("doc_id", "pos", "level", "text"), "pos")


@query(
    "k20_nested_sections",
    f"""WITH {NODES_SQL}, o AS (
          SELECT doc_id, pos, depth, lead(depth) OVER (PARTITION BY doc_id ORDER BY pos) AS following,
            '{{"level":"' || level || '","text":' || to_json(text) || ',"start":' || start_index || ',"end":' || end_index
            || CASE WHEN level = 'text' THEN '' ELSE ',"heading_id":"' || heading_id || '"' END || ',"subsections":[' AS open FROM tree),
        p AS (SELECT *, open || repeat(']}}', CASE WHEN following IS NULL THEN depth + 1 ELSE depth - following + 1 END)
            || CASE WHEN following IS NOT NULL AND following <= depth THEN ',' ELSE '' END AS piece FROM o)
        SELECT doc_id, '[' || string_agg(piece, '' ORDER BY pos) || ']' AS sections FROM p GROUP BY doc_id""",
)
def k20(spark, sf):
    return sections.nested_json(_nodes(spark, sf))


def _parts(spark, sf):
    """Text ranges: a paragraph per element and inside it a run, a chip or a date."""
    e = inputs.elements(spark, sf).withColumn("size", F.col("end_index") - F.col("start_index"))
    paragraphs = e.select(
        "doc_id", "start_index", "end_index", F.lit(1).alias("depth"),
        F.when(F.col("level") == "TITLE", "cell").otherwise("paragraph").alias("kind"), F.lit(None).cast("string").alias("content"),
    )
    kind = F.when(F.col("size") <= 30, "date").when(F.col("size") <= 60, "chip").otherwise("run")
    content = F.when(F.col("level") == "HEADING_6", F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    inner = e.where(F.col("level") != "TITLE").select(
        "doc_id", "start_index", "end_index", F.lit(2).alias("depth"), kind.alias("kind"), F.when(kind == "run", content).alias("content")
    )
    return paragraphs.unionByName(inner)


PIECES_SQL = f"""{ELEMENTS_SQL}, pieces AS (SELECT doc_id, pos, start_index, end_index, level,
    CAST(end_index - start_index AS BIGINT) AS size,
    CASE WHEN level = 'TITLE' THEN 'cell' WHEN end_index - start_index <= 30 THEN 'date' WHEN end_index - start_index <= 60 THEN 'chip' ELSE 'run' END AS kind,
    CASE WHEN level = 'HEADING_6' THEN left(text, -1) ELSE text END AS content FROM elements),
  shown AS (SELECT *, CASE kind WHEN 'cell' THEN repeat(chr(327679), size) WHEN 'date' THEN repeat(chr(393215), size)
      WHEN 'chip' THEN repeat(chr(458751), size) ELSE content || CASE WHEN level = 'HEADING_6' THEN chr(524287) ELSE '' END END AS t FROM pieces)"""


@query(
    "x11_render_text",
    f"WITH {PIECES_SQL} SELECT doc_id, md5(chr(131071) || string_agg(t, '' ORDER BY pos)) AS digest FROM shown GROUP BY doc_id",
)
def x11(spark, sf):
    return sections.render_text(_parts(spark, sf)).select("doc_id", F.md5("text").alias("digest"))


@query(
    "x12_alignment_audit",
    f"""WITH {PIECES_SQL} SELECT doc_id, start_index, end_index, kind FROM shown JOIN documents d USING (doc_id)
        WHERE d.lang = 'fr' AND kind = 'run' AND contains(content, 'e')""",
)
def x12(spark, sf):
    parts = _parts(spark, sf)
    french = table(spark, sf, "documents").where("lang = 'fr'").select("doc_id", F.lit(True).alias("french"))
    texts = sections.render_text(parts).join(french, "doc_id", "left")
    # French texts are damaged after rendering, so their runs no longer stand where they should.
    damaged = F.when(F.col("french"), F.replace("text", F.lit("e"), F.lit("x"))).otherwise(F.col("text"))
    out = sections.misaligned(parts, texts.select("doc_id", damaged.alias("text")))
    return out.select("doc_id", "start_index", "end_index", "kind")


def _edits(spark, sf):
    """Per line of a document: put its number before a text line, cut the text of a heading line."""
    e = inputs.elements(spark, sf)
    cut = F.col("level") != "NORMAL_TEXT"
    return e.select(
        "doc_id",
        F.col("pos").cast("long").alias("seq"),
        F.when(cut, "delete").otherwise("insert").alias("kind"),
        F.col("start_index").alias("index"),
        F.when(cut, F.col("end_index") - 1).alias("end"),
        F.when(~cut, F.concat(F.lit("<"), F.col("pos").cast("string"), F.lit(">"))).alias("content"),
        F.array(F.concat_ws("|", "doc_id", "level")).alias("origin_ids"),
    )


@query(
    "e1_clamp_offsets",
    f"""WITH {ELEMENTS_SQL}, x AS (SELECT doc_id, pos, level <> 'NORMAL_TEXT' AS cut, max(end_index) OVER (PARTITION BY doc_id) - 1 AS last,
            CASE WHEN level = 'TITLE' THEN max(end_index) OVER (PARTITION BY doc_id) + pos // 2 WHEN level = 'HEADING_1' THEN -pos ELSE start_index END AS a,
            end_index - 3 AS b FROM elements),
        y AS (SELECT *, greatest(least(a, last - 1), 1) AS ca, greatest(least(b, last - 1), 1) AS cb FROM x)
        SELECT doc_id, CAST(pos AS BIGINT) AS seq, CASE WHEN cut THEN least(ca, cb) ELSE ca END AS index, CASE WHEN cut THEN greatest(ca, cb) END AS "end",
          CASE WHEN CASE WHEN cut THEN greatest(a, b) ELSE a END > last + 3 THEN 'far beyond document end'
               WHEN CASE WHEN cut THEN least(a, b) ELSE a END < -3 THEN 'far before document start' END AS error FROM y""",
)
def e1(spark, sf):
    e = inputs.elements(spark, sf)
    ends = e.groupBy("doc_id").agg((F.max("end_index") - 1).alias("last"))
    raw = _edits(spark, sf).join(ends, "doc_id")
    level = F.substring_index(F.col("origin_ids")[0], "|", -1)
    index = F.when(level == "TITLE", F.col("last") + 1 + F.expr("seq div 2")).when(level == "HEADING_1", -F.col("seq"))
    moved = raw.withColumn("index", F.coalesce(index, F.col("index"))).withColumn("end", F.col("end") - 2)
    return edits.clamp(moved, F.col("last")).select("doc_id", "seq", "index", "end", "error")


@query(
    "l3_edit_order",
    f"""WITH {ELEMENTS_SQL}, x AS (SELECT doc_id, pos, level <> 'NORMAL_TEXT' AS cut, start_index // 400 AS index FROM elements)
        SELECT doc_id, CAST(pos AS BIGINT) AS seq, row_number() OVER (PARTITION BY doc_id ORDER BY index DESC, cut DESC, pos) - 1 AS place FROM x""",
)
def l3(spark, sf):
    from officelake.operators.ordering import ordinal

    tied = _edits(spark, sf).withColumn("index", F.expr("index div 400"))
    return ordinal(tied, ["doc_id"], edits.edit_order(), "place").select("doc_id", "seq", "place")


@query(
    "e2_apply_edits",
    f"""WITH {ELEMENTS_SQL} SELECT doc_id, md5(string_agg(CASE WHEN level = 'NORMAL_TEXT' THEN '<' || pos || '>' || text ELSE chr(10) END, '' ORDER BY pos)) AS digest
        FROM elements GROUP BY doc_id""",
)
def e2(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\n")).alias("text"))
    return edits.apply_edits(d, _edits(spark, sf)).select("doc_id", F.md5("text").alias("digest"))


@query("e2_executed_ids", f"WITH {ELEMENTS_SQL} SELECT DISTINCT doc_id, doc_id || '|' || level AS origin_id FROM elements")
def e2_ids(spark, sf):
    return edits.executed_ids(_edits(spark, sf))


@query(
    "e3_sequential_inserts",
    f"""WITH {ELEMENTS_SQL} SELECT doc_id, CAST(pos AS BIGINT) AS seq, 'forward' AS mode, 9 + start_index AS insert_at, 9 + end_index AS next_index FROM elements
        UNION ALL SELECT doc_id, CAST(pos AS BIGINT), 'fixed', 10, 10 FROM elements""",
)
def e3(spark, sf):
    contents = inputs.elements(spark, sf).select("doc_id", F.col("pos").cast("long").alias("seq"), F.col("text").alias("content"))
    at = F.lit(10).cast("long")
    parts = [
        edits.sequential_inserts(contents, at, forward).select(
            "doc_id", "seq", F.lit("forward" if forward else "fixed").alias("mode"), "insert_at", "next_index"
        )
        for forward in (True, False)
    ]
    return parts[0].unionByName(parts[1])


@query(
    "e4_insert_position",
    f"""WITH {EXTENTS_SQL}, m AS (SELECT *, CASE WHEN rank IN (0, 1) THEN 'start' WHEN rank IN (2, 3) THEN 'end' ELSE 'replace' END AS mode,
            CASE WHEN rank = 7 THEN start_index ELSE end_index END AS s, CASE WHEN rank = 7 THEN end_index ELSE subsections_end END AS e FROM extents)
        SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE mode WHEN 'start' THEN end_index WHEN 'end' THEN subsections_end ELSE s END AS insert_at,
          CASE WHEN mode = 'replace' AND e > s THEN s END AS delete_from, CASE WHEN mode = 'replace' AND e > s THEN e END AS delete_to FROM m""",
)
def e4(spark, sf):
    mode = F.when(F.col("rank") <= 1, "start").when(F.col("rank") <= 3, "end").otherwise("replace")
    out = sections.insert_position(sections.extents(_nodes(spark, sf)), mode)
    return _longs(out.select("doc_id", "pos", "insert_at", "delete_from", "delete_to"), "pos")


@query(
    "e5_shift_spans",
    f"""WITH {ELEMENTS_SQL} SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN pos > 0 THEN start_index + pos END AS first_start,
        CASE WHEN pos > 0 THEN end_index + 2 + pos END AS last_end, CASE WHEN pos = 0 THEN 'Offset cannot be less than 1, was 0' END AS error FROM elements""",
)
def e5(spark, sf):
    spans = F.array(
        F.struct(F.col("start_index").alias("start"), F.col("end_index").alias("end")),
        F.struct(F.col("end_index").alias("start"), (F.col("end_index") + 2).alias("end")),
    )
    e = inputs.elements(spark, sf).withColumn("pos", F.col("pos").cast("long"))
    r = e.select("doc_id", "pos", edits.shift_spans(spans, F.col("pos")).alias("r"))
    return r.select("doc_id", "pos", F.col("r.value")[0]["start"].alias("first_start"), F.col("r.value")[1]["end"].alias("last_end"), "r.error")


@query(
    "e6_newline_guard",
    f"""WITH {ELEMENTS_SQL}, i AS (SELECT doc_id, pos, CASE WHEN level = 'NORMAL_TEXT' THEN start_index ELSE start_index + 2 END AS index FROM elements),
        j AS (SELECT *, EXISTS (SELECT 1 FROM elements e WHERE e.doc_id = i.doc_id AND e.end_index = i.index) AS ok FROM i)
        SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN ok THEN '' ELSE chr(10) END AS prefix, CASE WHEN ok THEN index ELSE index + 1 END AS final_index,
          CASE WHEN index <= 1 THEN 'cannot insert before the start of the document' END AS error FROM j""",
)
def e6(spark, sf):
    e = inputs.elements(spark, sf)
    index = F.when(F.col("level") == "NORMAL_TEXT", F.col("start_index")).otherwise(F.col("start_index") + 2)
    out = edits.newline_guard(e.select("doc_id", F.col("pos").cast("long").alias("pos"), index.alias("index")), e)
    return out.select("doc_id", "pos", "prefix", "final_index", "error")


@query(
    "e7_item_edits",
    f"""WITH {inputs.ITEMS_SQL} SELECT l_suppkey AS doc_id, action_number AS seq, 'insert' AS kind, 7 AS index, title AS content,
        analysis_id || '|' || action_number AS origin FROM items""",
)
def e7(spark, sf):
    items = inputs.action_items(spark, sf).withColumn("doc_id", F.col("l_suppkey"))
    out = edits.item_edits(items, F.lit(7), F.col("title"), F.col("action_number"))
    return out.select("doc_id", "seq", "kind", F.col("index").cast("int").alias("index"), "content", F.col("origin_ids")[0].alias("origin"))


@query(
    "e8_splice",
    """SELECT doc_id, md5(left(text, CAST(n_chars // 2 AS BIGINT)) || 'NEW' || substr(text, n_chars // 2 + 1)) AS inserted,
       md5(left(text, CAST(n_chars // 3 AS BIGINT)) || substr(text, n_chars // 2 + 1)) AS deleted FROM documents""",
)
def e8(spark, sf):
    half, third = F.expr("n_chars div 2 + 1"), F.expr("n_chars div 3 + 1")
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.md5(edits.insert_text(F.col("text"), half, F.lit("NEW"))).alias("inserted"),
        F.md5(edits.delete_range(F.col("text"), third, half)).alias("deleted"),
    )
