"""What is read several times is computed once: kept as columns, and no part of the plans that read it."""

import pytest
from pyspark.sql import functions as F

from officelake.inference.stub import SINGLE
from officelake.operators import rendering, sections
from officelake.operators.edits import apply_edits
from officelake.plans import jobs
from officelake.session import work_dir
from officelake.sinks import merge
from officelake.sinks.store import TableStore
from officelake.sources import documents


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mails_are_parsed_and_taken_apart_once(spark):
    raw = "Content-Type: text/html\n\n<p>one <b>two</b></p><ul><li>three</li></ul>"
    mails = spark.createDataFrame([("a", bytearray(raw.encode())), ("b", None)], "id string, raw binary")
    out = rendering.mail_bodies(mails, "id", "raw")
    assert "regexp_extract_all(body" not in plan(out)
    assert {r["id"]: r["value"] for r in out.collect()} == {"a": "one **two**\n\n* three\n", "b": None}


def test_pages_of_todos_are_rendered_once(spark):
    pages = spark.createDataFrame([(1, "<p>text</p>"), (2, "<p><br></p>"), (3, None)], "page_id long, html string")
    columns = "id long, tasklist_id string, title string, notes string, status string"
    out = jobs.todos_to_tasks(pages, "html", "page_id", SINGLE, spark.createDataFrame([], columns), [F.col("id")])
    assert "collect_list" not in plan(out.where("error IS NOT NULL"))
    assert sorted((r["id_url"], r["actions"]) for r in out.collect()) == [("http://pages/1", ["create"]), ("http://pages/2", ["error"]), ("http://pages/3", ["error"])]


def test_documents_are_parsed_and_ranges_found_once(spark):
    body = '{"documentId":"d","body":{"content":[{"endIndex":4,"paragraph":{"elements":[{"startIndex":0,"endIndex":4,"textRun":{"content":"abc\\n"}}]}}]}}'
    rows = [(body,), ("{",), (None,), ('{"documentId":"empty","body":{"content":[]}}',), ('{"documentId":"none"}',)]
    ranges = documents.document_ranges(spark.createDataFrame(rows, "json string"), "json")
    assert "parse_json" not in plan(ranges)
    assert sorted((str(r["doc_id"]), str(r["kind"]), str(r["error"])) for r in ranges.collect()) == [
        ("None", "None", "not a JSON document"), ("d", "paragraph", "None"), ("d", "run", "None"),
    ]
    text = sections.render_text(ranges)
    assert "variant_get" not in plan(text)
    assert [(r["doc_id"], r["text"]) for r in text.collect()] == [("d", "abc\n")]


def test_placed_todos_keep_only_what_is_rendered_and_recorded(spark, monkeypatch):
    kept = []
    keep = jobs.pin_columns
    monkeypatch.setattr(jobs, "pin_columns", lambda df: kept.append(df.columns) or keep(df))
    items = spark.createDataFrame(
        [("a", 0, 1, "high"), ("a", 1, 1, "high"), ("b", 0, 2, "low"), ("c", 0, 9, "high")], "analysis_id string, action_number int, doc_id long, priority string"
    ).select(
        "*", F.struct("analysis_id", "action_number").alias("seq"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("due_date"),
        F.lit(None).cast("string").alias("notes"), F.lit(None).cast("array<struct<title:string,url:string>>").alias("links"), F.lit("x").alias("payload"),
    )
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    store = TableStore(spark, work_dir(spark, "store"))
    url = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    for _ in range(2):
        edited = jobs.place_todos(store, items, docs, url, F.lit(1), [F.col("seq")], priority="high", limit=None)
        assert edited.columns == ["doc_id", "text"]
    assert kept and not any("payload" in columns for columns in kept)
    assert sorted((r["analysis_id"], r["action_number"]) for r in store.read("placement").collect()) == [("a", 0), ("a", 1)]
    saved = {r["doc_id"]: r["text"] for r in store.read("edited").collect()}
    assert list(saved) == [1] and saved[1].endswith("one") and saved[1].count(" t ") == 2
    assert [r["doc_id"] for r in store.read("unplaced").collect()] == [9]


def test_rows_that_are_all_key_need_no_order(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None)], "k long, v string")
    found = merge.one_per_key(rows, ["k", "v"], None)
    assert "to_json" not in plan(found)
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.distinct().collect())) and found.count() == 3


@pytest.mark.parametrize("flag", [None, "touched"])
def test_edited_documents_may_be_flagged(spark, flag):
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (None, "ef")], "doc_id long, text string")
    edits = spark.createDataFrame(
        [(1, 0, "insert", 1, None, "x"), (1, 1, "insert", 2, None, "y"), (None, 0, "insert", 1, None, "z")],
        "doc_id long, seq int, kind string, index long, end long, content string",
    )
    out = apply_edits(docs, edits, flag)
    assert out.columns == ["doc_id", "text"] + [flag] * bool(flag)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "xayb", 2: "cd", None: "ef"}
    if flag:
        assert {r["doc_id"]: r[flag] for r in out.collect()} == {1: True, 2: False, None: False}
