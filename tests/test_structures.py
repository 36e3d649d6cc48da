"""Grids, sections, rendering and edits against brute force and golden structures."""

import random

import pytest
from pyspark.sql import functions as F

from officelake.sources import documents
from officelake.operators import bus, edits, grid, rules, sections
from officelake.schemas import CELL_VALUE

CELL = CELL_VALUE.simpleString()


def cell(v):
    out = dict.fromkeys(CELL_VALUE.fieldNames())
    if isinstance(v, bool):
        out["boolValue"] = v
    elif isinstance(v, (int, float)):
        out["numberValue"] = float(v)
    elif isinstance(v, str) and v.startswith("="):
        out["formulaValue"] = v
    elif v is not None:
        out["stringValue"] = v
    return tuple(out.values())


def used(rows, accepted, include):
    out, empties = [], 0
    for n, values in enumerate(rows):
        if all(v in (None, "") for v in values):
            empties += 1
            if empties > accepted:
                break
            if include:
                out.append(n)
        else:
            empties = 0
            out.append(n)
    return out


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("accepted, include", [(0, False), (1, False), (1, True), (2, True)])
def test_used_rows(spark, accepted, include, bounded):
    rng = random.Random(accepted)
    grids = {g: [[rng.choice([None, "", "v", 3]) if rng.random() < 0.6 else "", None] for _ in range(rng.randrange(40))] for g in range(60)}
    data = [(g, 5, n + 5, [cell(v) for v in row]) for g, rows in grids.items() for n, row in enumerate(rows)]
    df = spark.createDataFrame(data, f"g int, start_row int, row_num long, values array<{CELL}>")
    got = {}
    for r in grid.used_rows(df, ["g"], accepted, include, block=8, bounded=bounded).collect():  # small blocks: runs cross their borders
        got.setdefault(r["g"], []).append(r["row_num"] - 5)
    want = {g: used(rows, accepted, include) for g, rows in grids.items()}
    assert {g: sorted(v) for g, v in got.items()} == {g: v for g, v in want.items() if v}


def test_cells_and_fields(spark):
    values = [None, 22, "abc", True, "=123"]
    df = spark.createDataFrame([(0, 0, [cell(v) for v in values])], f"start_row int, row_num int, values array<{CELL}>")
    merged = df.select(F.transform("values", lambda c: grid.merged_value(c)).alias("m")).first()["m"]
    assert [(m["kind"], m["value"]) for m in merged] == [
        (None, None), ("number", "22.0"), ("string", "abc"), ("bool", "true"), ("formula", "=123"),
    ]
    two = df.select(grid.merged_value(F.col("values")[1].withField("stringValue", F.lit("x"))).alias("m")).first()["m"]
    assert two["value"] is None and two["error"].startswith("Only one")
    short = df.withColumn("values", F.slice("values", 1, 2))
    got = grid.to_fields(short, [], ["a", "b", grid.Field("c", default="333")], "n").first()
    assert tuple(got) == (None, "22.0", "333", 0)
    wide = grid.normalise(short, [], 4)
    assert [c is None for c in wide.first()["values"]] == [False, False, True, True]
    assert grid.bad_first_row(df.withColumn("start_row", F.lit(3)), [], 1).count() == 1


def tree(levels):
    """Parents by definition: the nearest earlier heading of a higher rank; runs of text are one node."""
    rank = {h: i for i, h in enumerate(sections.HEADINGS)}
    nodes = []
    for pos, level in enumerate(levels):
        r = rank.get(level, 7)
        if r == 7 and nodes and nodes[-1][1] == 7:
            continue
        parent = next((p for p, q in reversed(nodes) if q < r), None)
        nodes.append((pos, r))
        yield pos, r, parent


def elements(spark, docs):
    rows = [
        (d, pos, 1 + 10 * pos, 11 + 10 * pos, level, f"h.{pos}" if level != "NORMAL_TEXT" else None, f"{level} {pos}\n")
        for d, levels in docs.items()
        for pos, level in enumerate(levels)
    ]
    return spark.createDataFrame(
        rows, "doc_id int, pos int, start_index long, end_index long, level string, heading_id string, text string"
    )


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    levels = sections.HEADINGS + ["NORMAL_TEXT"] * 4
    return {d: [rng.choice(levels) for _ in range(rng.randrange(1, 30))] for d in range(150)}


def test_section_tree(spark, docs):
    got = {(r["doc_id"], r["pos"]): (r["rank"], r["parent"]) for r in sections.section_nodes(elements(spark, docs)).collect()}
    want = {(d, pos): (r, parent) for d, levels in docs.items() for pos, r, parent in tree(levels)}
    assert got == want


def test_extents(spark, docs):
    nodes = sections.extents(sections.section_nodes(elements(spark, docs))).collect()
    by_doc = {}
    for n in nodes:
        by_doc.setdefault(n["doc_id"], []).append(n)
    for rows in by_doc.values():
        rows.sort(key=lambda n: n["pos"])
        for i, n in enumerate(rows):
            last = n
            for m in rows[i + 1 :]:
                if n["rank"] == 7 or m["rank"] <= n["rank"]:
                    break
                last = m
            assert n["subsections_end"] == last["end_index"]


def test_find_sections_hides_below_a_match(spark):
    doc = {1: ["TITLE", "HEADING_1", "HEADING_2", "NORMAL_TEXT", "HEADING_1", "NORMAL_TEXT"]}
    nodes = sections.section_nodes(elements(spark, doc))
    assert [r["pos"] for r in sections.find_sections(nodes, heading="HEADING").orderBy("pos").collect()] == [1, 4]
    assert [r["pos"] for r in sections.find_sections(nodes, text="TEXT").orderBy("pos").collect()] == [3, 5]
    assert sections.find_section(nodes, ["HEADING_1//4", "TEXT"]).first()["pos"] == 5
    assert sections.find_section(nodes, ["##h.2"]).first()["pos"] == 2
    assert sections.find_section(nodes, ["nothing"]).count() == 0


def test_nested_json(spark, docs):
    import json

    def flat(items, depth=0):
        for x in items:
            yield x["start"], depth
            yield from flat(x["subsections"], depth + 1)

    nodes = sections.section_nodes(elements(spark, docs))
    want = {}
    for n in nodes.orderBy("doc_id", "pos").collect():
        want.setdefault(n["doc_id"], []).append((n["start_index"], n["depth"]))
    got = {r["doc_id"]: list(flat(json.loads(r["sections"]))) for r in sections.nested_json(nodes).collect()}
    assert got == want


def test_render_table(spark):
    rows = [
        (1, 1, 4, 1, "paragraph", None), (1, 1, 4, 2, "run", "ab\n"),
        (1, 4, 14, 1, "table", None), (1, 5, 9, 2, "row", None), (1, 6, 9, 3, "cell", None), (1, 7, 9, 5, "run", "x\n"),
        (1, 9, 12, 2, "row", None), (1, 10, 12, 3, "cell", None), (1, 11, 12, 5, "chip", None),
        (1, 14, 17, 1, "paragraph", None), (1, 14, 17, 2, "run", "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, start_index long, end_index long, depth int, kind string, content string")
    f = sections.FILLERS
    text = sections.render_text(df).first()["text"]
    assert text == (
        sections.NON_CHAR + "ab\n" + f["table"] + f["row"] + f["cell"] + "x\n" + f["row"] + f["cell"] + f["chip"] + f["table"] * 2 + "z" + f["run"] * 2
    )
    assert sections.misaligned(df, spark.createDataFrame([(1, text)], "doc_id int, text string")).count() == 0
    assert sections.misaligned(df, spark.createDataFrame([(1, text.replace("b", "q"))], "doc_id int, text string")).count() == 1


def run(start, text):
    return {"startIndex": start, "endIndex": start + len(text), "textRun": {"content": text}}


def paragraph(start, text, style="NORMAL_TEXT"):
    return {"startIndex": start, "endIndex": start + len(text), "paragraph": {"elements": [run(start, text)], "paragraphStyle": {"namedStyleType": style}}}


def test_document_json_has_all_its_ranges(spark):
    import json

    inner = {"startIndex": 12, "endIndex": 20, "table": {"tableRows": [{"startIndex": 13, "endIndex": 19, "tableCells": [{"startIndex": 14, "endIndex": 19, "content": [paragraph(15, "deep")]}]}]}}
    outer = {"startIndex": 7, "endIndex": 22, "table": {"tableRows": [{"startIndex": 8, "endIndex": 21, "tableCells": [{"startIndex": 9, "endIndex": 21, "content": [paragraph(10, "a\n"), inner]}]}]}}
    body = [{"endIndex": 1, "sectionBreak": {}}, paragraph(1, "Title\n", "HEADING_1"), outer, {"startIndex": 22, "endIndex": 24, "strange": {}}]
    body.append({"startIndex": 24, "endIndex": 30, "tableOfContents": {"content": [paragraph(25, "Title")]}})
    texts = [(json.dumps({"documentId": "d", "body": {"content": body}}),), ("no json",), (None,)]
    df = spark.createDataFrame(texts, "json string")
    got = documents.document_ranges(df, "json").collect()
    runs = sorted((r["start_index"], r["depth"], r["content"]) for r in got if r["kind"] == "run")
    assert runs == [(1, 2, "Title\n"), (10, 5, "a\n"), (15, 8, "deep"), (25, 3, "Title")]
    assert sorted(r["kind"] for r in got if r["kind"] and r["kind"] not in ("run", "paragraph")) == ["cell", "cell", "contents", "row", "row", "section_break", "table", "table", "unknown"]
    assert sum(r["error"] is not None for r in got) == 2
    top = documents.parse_documents(df.where("json LIKE '{%'"), "json").orderBy("pos").collect()
    assert [(r["level"], r["text"]) for r in top] == [("NORMAL_TEXT", None), ("HEADING_1", "Title\n"), ("NORMAL_TEXT", None), ("NORMAL_TEXT", None), ("NORMAL_TEXT", None)]
    ranges = documents.document_ranges(df.where("json LIKE '{%'"), "json").where("error IS NULL")
    text = sections.render_text(ranges).first()["text"]
    assert text[1:7] == "Title\n" and text[10:12] == "a\n" and text[15:19] == "deep" and text[7] == sections.FILLERS["table"]


def test_render_any_depth(spark):
    deep = [(1, d, 40 - d, d, "cell", None) for d in range(1, 13)] + [(1, 13, 16, 13, "run", "abc")]
    df = spark.createDataFrame(deep, "doc_id int, start_index long, end_index long, depth int, kind string, content string")
    text = sections.render_text(df).first()["text"]
    assert text[13:16] == "abc" and sections.misaligned(df, spark.createDataFrame([(1, text)], "doc_id int, text string")).count() == 0


def apply_slow(text, ops):
    units = text.encode("utf-16-le")
    for kind, index, end, content, _ in sorted(ops, key=lambda o: (-o[1], 0 if o[0] == "delete" else 1, o[4])):
        at = 2 * (index - 1)
        units = units[:at] + units[2 * (end - 1) :] if kind == "delete" else units[:at] + content.encode("utf-16-le") + units[at:]
    return units.decode("utf-16-le")


def test_apply_edits(spark):
    rng = random.Random(9)
    texts = {d: "".join(rng.choice("abcé") for _ in range(60)) + "\U0001f534" for d in range(8)}
    ops = {d: [] for d in texts}
    for d in texts:
        for seq in range(rng.randrange(12)):
            i = rng.randrange(1, 55)
            kind = rng.choice(["insert", "delete"])
            ops[d].append((kind, i, i + rng.randrange(5) if kind == "delete" else None, f"<{seq}>" if kind == "insert" else None, seq))
    rows = [(d, *o) for d, mine in ops.items() for o in mine]
    e = spark.createDataFrame(rows, "doc_id int, kind string, index long, end long, content string, seq int")
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in edits.apply_edits(docs, e).collect()}
    assert got == {d: apply_slow(texts[d], ops[d]) for d in texts}


def test_edit_order_and_clamp(spark):
    e = spark.createDataFrame(
        [("insert", 5, None, 0), ("insert", 10, None, 1), ("delete", 10, 15, 2), ("insert", 10, None, 3)],
        "kind string, index long, end long, seq int",
    )
    assert [r["seq"] for r in e.orderBy(*edits.edit_order()).collect()] == [2, 1, 3, 0]
    raw = spark.createDataFrame([("insert", 23, None), ("insert", 24, None), ("insert", -3, None), ("insert", -4, None), ("delete", 30, 5), ("delete", 9, 4)],
                                "kind string, index long, end long")
    got = [(r["index"], r["end"], r["error"]) for r in edits.clamp(raw, F.lit(20)).collect()]
    assert got[0] == (19, None, None) and got[1][2] and got[2] == (1, None, None) and got[3][2] and got[4][2]
    assert got[5] == (4, 9, None)


def test_sequential_inserts(spark):
    df = spark.createDataFrame([(1, 0, "A" * 5), (1, 1, "B")], "doc_id int, seq int, content string")
    fixed = edits.sequential_inserts(df, F.lit(10), False).orderBy("seq").collect()
    moving = edits.sequential_inserts(df, F.lit(10), True).orderBy("seq").collect()
    assert [r["insert_at"] for r in fixed] == [10, 10]
    assert [r["insert_at"] for r in moving] == [10, 15]


def test_bus(spark):
    log = spark.createDataFrame([(i, "t", f"m{i}") for i in range(1, 111)] + [(200, "u", "late")], "id long, topic string, message string")
    kept = bus.retained(log, 100).where("topic = 't'").agg(F.min("id"), F.count("*")).first()
    assert tuple(kept) == (11, 100)
    assert bus.retained(log, 0).count() == 111
    assert bus.peek(log, 0).count() == 0
    assert sorted(r["id"] for r in bus.peek(log, 3, "t").collect()) == [108, 109, 110]
    subs = spark.createDataFrame([("b", "t"), ("b", "u"), ("c", "t"), ("d", "t")], "agent string, topic string")
    cursors = spark.createDataFrame([("c", "t", 40), ("d", "t", 110)], "agent string, topic string, offset long")
    for block in (7, 1000):
        got = {(r["agent"], r["topic"]): r["next_id"] for r in bus.next_ids(log, subs, cursors, block).collect()}
        assert got == {("b", "t"): 1, ("b", "u"): 200, ("c", "t"): 41, ("d", "t"): None}
    first, moved = bus.receive(log, subs, cursors)
    assert {r["agent"]: r["id"] for r in first.collect()} == {"b": 1, "c": 41}
    second, _ = bus.receive(log, subs, moved)
    assert {r["agent"]: r["id"] for r in second.collect()} == {"b": 2, "c": 42}


def test_rules(spark):
    df = spark.createDataFrame([("g", x) for x in range(-20, 20)], "g string, x int")
    clash = [rules.Rule("above", "x > 10", "x is large"), rules.Rule("below", "x < 5"), rules.Rule("any", "x > -100")]
    assert rules.consistency(df, ["g"], clash).first()["status"] == "UNSAT"
    assert rules.conflict_core(df, ["g"], clash).first()["core"] == ["above", "below"]
    status = lambda *p: rules.solutions(df, ["g"], ["x"], [rules.Rule(str(i), q) for i, q in enumerate(p)]).first()
    assert status("x = 3")["status"] == "SAT" and status("x = 3")["model"]["x"] == 3
    assert status("x > 3")["status"] == "AMBIGUOUS" and status("x > 3")["model"]["x"] == 4
    with pytest.raises(ValueError):
        rules.audit(df, [rules.Rule("a", "x > 1"), rules.Rule("a", "x > 2")])
