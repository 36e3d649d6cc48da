"""Keyed state: merges, sync, cache, exports, jobs run twice, streams."""

import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from officelake.inference import cache, model
from officelake.inference.model import ModelSpec, RetryableError
from officelake.inference.stub import SINGLE
from officelake.plans import jobs
from officelake.session import work_dir
from officelake.sinks import exports, merge, sync
from officelake.sinks.store import CommitConflict, TableStore
from officelake.sources import calendar, mailbox, tasks
from officelake.streaming import jobs as stream_jobs
from officelake.streaming.receive import deliveries, unseen, with_ids

def at():
    return F.lit("2024-01-01").cast("timestamp")


@pytest.fixture
def store(spark):
    return TableStore(spark, work_dir(spark, "store"))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upsert_and_insert(spark, store):
    a = spark.createDataFrame([("i", "path", 1)], "id string, path string, n int")
    merge.insert(store, "t", a, ["id"])
    with pytest.raises(merge.DuplicateKey):
        merge.insert(store, "t", a, ["id"])
    back = merge.upsert(store, "t", spark.createDataFrame([("i", "pathx"), ("j", None)], "id string, path string"), ["id"])
    assert rows(back, "id", "path", "n") == [("i", "pathx", 1), ("j", None, None)]
    nulls = spark.createDataFrame([("i", None, 5)], "id string, path string, n int")
    assert rows(merge.upsert(store, "t", nulls, ["id"]), "id", "path", "n") == [("i", None, 5)]


def test_upsert_last_of_several(spark, store):
    src = spark.createDataFrame([("i", "a", 1), ("i", "b", 2)], "id string, v string, seq int")
    assert rows(merge.upsert(store, "t", src, ["id"], [F.col("seq")]), "id", "v") == [("i", "b")]


def test_merge_rewrites_only_its_buckets(spark, store):
    big = spark.range(500).select(F.col("id"), F.lit("old").alias("v"))
    store.replace("t", big, ["id"])
    before = store._latest()[1]["t"]["dirs"]
    merge.upsert(store, "t", spark.createDataFrame([(7, "new")], "id int, v string"), ["id"])  # int meets long
    after = store._latest()[1]["t"]["dirs"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) > 1
    assert store.read("t").count() == 500 and rows(store.read("t").where("v = 'new'"), "id") == [(7,)]


def test_commit_conflict_and_invisible_staging(spark, store):
    df = spark.range(3)
    one, two = store.begin(), store.begin()
    one.replace("t", df)
    assert not store.exists("t")
    two.replace("t", df)
    one.commit()
    with pytest.raises(CommitConflict):
        two.commit()
    assert store.read("t").count() == 3


def test_reader_keeps_its_version(spark, store):
    store.replace("t", spark.range(3))
    old = store.read("t")
    store.replace("t", spark.range(5))
    assert (old.count(), store.read("t").count()) == (3, 5)


def test_upsert_task_actions(spark):
    kind = "id string, title string, etag string, position int"
    old = spark.createDataFrame([("1", "same", "e1", 4), ("2", "before", "e1", 0)], kind)
    new = spark.createDataFrame([("1", "same", "e2", 9), ("2", "after", "e1", 0), ("3", "x", None, 0), (None, "n", None, 0)], kind)
    got = {r["title"]: r["action"] for r in sync.upsert_tasks(new, old).collect()}
    assert got == {"same": "noop", "after": "update", "x": "error", "n": "create"}


def test_upsert_managed_task_actions(spark):
    kind = "id string, tasklist_id string, title string, notes string, links array<string>"
    old = spark.createDataFrame(
        [("1", "l1", "t", "\U0001f517u1", ["x"]), ("2", "l1", "t", "\U0001f517u2\nnote", None), ("3", "l1", "t", "\U0001f517u1", None)], kind
    )
    new = spark.createDataFrame(
        [("u1", None, "t", None, []), ("u2", "l2", None, "note", None), ("u3", None, "new", None, None), (None, None, "bad", None, None)],
        "id_url string, tasklist_id string, title string, notes string, links array<string>",
    )
    got = {r["id_url"]: r for r in sync.upsert_managed(new, old, [F.col("tasklist_id"), F.col("id")]).collect()}
    assert got["u1"]["actions"] == ["noop"] and got["u1"]["id"] == "1" and got["u1"]["links"] == ["x"]
    assert got["u2"]["actions"] == ["move"] and got["u2"]["tasklist_id"] == "l2" and got["u2"]["title"] == "t"
    assert got["u3"]["actions"] == ["create"] and got["u3"]["tasklist_id"] == "@default"
    assert got["u3"]["notes"] == "\U0001f517u3"
    assert got[None]["actions"] == ["error"]


def test_change_table(spark):
    old = spark.createDataFrame([(1, "l", "a"), (2, "l", "b"), (3, "l", "c")], "id int, tasklist_id string, title string")
    ch = spark.createDataFrame(
        [(1, "U", "l", "A"), (2, "M", "k", "zz"), (3, "D", None, None), (4, "I", "l", "d"), (9, "U", "l", "x")],
        "id int, op string, tasklist_id string, title string",
    )
    got = {r["id"]: tuple(r)[1:] for r in merge.apply_changes(old, ch, "id").collect()}
    assert got[1] == ("l", "A", "updated") and got[2] == ("k", "b", "moved") and got[3][2] == "deleted"
    assert got[4] == ("l", "d", "inserted") and got[9][2] == "error: id not found"


def test_index_is_written_once_and_in_order(spark):
    path = work_dir(spark, "index")
    df = spark.createDataFrame([("msg_c", "2024-03-01"), ("msg_a", "2024-01-01"), ("msg_b", "2024-02-01")], "id string, received_date string")
    order = [F.col("received_date"), F.col("id")]
    assert exports.save_index(df, path, order) and not exports.save_index(df.repartition(3), path, order)
    assert [r["id"] for r in spark.read.json(path).orderBy("received_date").collect()] == ["msg_a", "msg_b", "msg_c"]
    assert exports.save_index(df.limit(2), path, order)
    assert mailbox.load_index(spark, path + "-missing").count() == 0


def test_index_array_file_and_corrupt_file(spark, tmp_path):
    (tmp_path / "index.json").write_text('[{"id": "a", "subject": "s", "url": "old", "seq": 1}, {"id": "a", "subject": "t", "seq": 2}]')
    assert rows(mailbox.load_index(spark, str(tmp_path), array_files=True), "id", "subject") == [("a", "t")]
    (tmp_path / "index.json").write_text("[{]")
    with pytest.raises(Exception):
        mailbox.load_index(spark, str(tmp_path), array_files=True).collect()


def test_recurrence(spark):
    e = spark.createDataFrame(
        [(1, "RRULE:FREQ=DAILY;INTERVAL=2;COUNT=3"), (2, "RRULE:FREQ=WEEKLY;UNTIL=19700115T000000Z"), (3, None), (4, "RRULE:FREQ=YEARLY;COUNT=2"), (5, "RRULE:FREQ=DAILY")],
        "id int, recurrence string",
    ).withColumns({"start_us": F.lit(0).cast("long"), "end_us": F.lit(5).cast("long")})
    got = {}
    for r in calendar.single_events(e).collect():
        got.setdefault(r["id"], []).append((r["start_us"] // 86_400_000_000, r["error"] is not None))
    assert sorted(got[1]) == [(0, False), (2, False), (4, False)]
    assert sorted(got[2]) == [(0, False), (7, False), (14, False)]
    assert got[3] == [(0, False)] and got[4] == [(0, True)] and got[5] == [(0, True)]


def test_task_flags(spark):
    t = spark.createDataFrame(
        [("1", "l", "needsAction", None, None), ("2", "l", "completed", None, None), ("3", "l", "needsAction", True, None), ("4", "m", "needsAction", None, True)],
        "id string, tasklist_id string, status string, deleted boolean, hidden boolean",
    )
    lists = spark.createDataFrame([("l",), ("m",)], "id string")
    assert rows(tasks.generate_tasks(t, lists), "id") == [("1",)]
    assert rows(tasks.generate_tasks(t, lists, "l", True, True, True), "id") == [("1",), ("2",), ("3",)]


def test_purge_prefix_overrides_field_by_field(spark):
    df = spark.createDataFrame(
        [("a", 10, 10), ("a", 30, 1), ("ab", 10, 10), ("ab", 3, 30), ("z", 25, 25)], "reg_key string, accessed_ago int, added_ago int"
    )
    calls = df.select("reg_key", "accessed_ago", "added_ago", *[(at() - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {c}_ago)")).alias(c) for c in ("accessed", "added")])
    kept = cache.purge(calls, at(), default_access=20.0, default_added=None, prefix_ages=[("ab", 5.0, None), ("a", None, 5.0)])
    assert rows(kept, "reg_key", "accessed_ago") == [("ab", 3)]


def test_model_is_called_once_per_prompt_and_retried(spark, store, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def factory():
        def ask(prompt):
            (log / uuid.uuid4().hex).write_text(prompt)
            if prompt == "flaky" and sum(p.read_text() == "flaky" for p in log.iterdir()) < 3:
                raise RetryableError("busy")
            if prompt == "bad":
                raise ValueError("no")
            return prompt.upper()

        return ask

    spec = ModelSpec("m", factory)
    df = spark.createDataFrame([("x",), ("x",), ("y",), ("bad",)], "p string")
    out = cache.cached_call(store, "calls", df, F.col("p"), spec, at())
    assert rows(out, "p", "value") == [("bad", None), ("x", "X"), ("x", "X"), ("y", "Y")]
    assert len(list(log.iterdir())) == 3
    cache.cached_call(store, "calls", df.where("p <> 'bad'"), F.col("p"), spec, at()).collect()
    assert len(list(log.iterdir())) == 3
    flaky = spark.createDataFrame([("flaky",), (None,)], "p string")
    got = flaky.select(model.generate_text(F.col("p"), spec, delay=0.01).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("FLAKY", None), (None, None)]


def test_crowded_buckets_of_the_cache_are_written_anew(spark, store):
    prompts = lambda n: spark.createDataFrame([(f"id: p{n}\n",), ("id: same\n",)], "p string")
    for n in range(cache.CROWDED + 4):
        cache.cached_call(store, "calls", prompts(n), F.col("p"), SINGLE, at()).collect()
    folders = store._latest()[1]["calls"]["dirs"].values()
    assert max(map(len, folders)) <= cache.CROWDED + 1
    assert store.read("calls").count() == cache.CROWDED + 5


def test_readers_never_see_an_index_in_between(spark):
    path = work_dir(spark, "index")
    first = spark.createDataFrame([(i,) for i in range(50)], "id long")
    exports.save_index(first, path, [F.col("id")])
    seen = []
    put = exports.put_in_place

    def watched(spark, staged, target):
        seen.append(spark.read.json(target).count())  # the new one has been written, the old one is still there
        put(spark, staged, target)

    exports.put_in_place = watched
    try:
        exports.save_index(first.where("id < 20"), path, [F.col("id")])
    finally:
        exports.put_in_place = put
    assert seen == [50] and spark.read.json(path).count() == 20


def test_stream_without_repetitions(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(30)], "k long, v long").withColumn("at", F.timestamp_seconds(F.col("v")))
    path = work_dir(spark, "arrivals")
    rows.repartition(3).write.parquet(path)
    for event_time in (None, "at"):
        target = work_dir(spark, "out")
        stream = stream_jobs.deduplicated(stream_jobs.file_stream(spark, path, rows.schema, 1), "k", event_time)
        out = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", work_dir(spark, "progress"))
        out.trigger(availableNow=True).start().awaitTermination()
        assert sorted(r["k"] for r in spark.read.parquet(target).collect()) == list(range(7))


def test_json_repair_takes_two_calls(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def factory():
        def ask(prompt):
            (log / uuid.uuid4().hex).write_text(prompt)
            return "```json\n[1,2,3]\n```" if prompt.startswith(model.REPAIR_INTRO) else "not JSON"

        return ask

    df = spark.createDataFrame([("p",)], "p string")
    got = model.generate_json(df, F.col("p"), ModelSpec("m", factory)).first()
    assert got["result"]["json"] == "[1,2,3]" and got["result"]["error"] is None
    assert len(list(log.iterdir())) == 2


def test_answers_are_parsed_once(spark):
    def factory():
        def ask(prompt):
            if prompt.startswith("fails"):
                raise ValueError("no")
            if prompt.startswith(model.REPAIR_INTRO):
                return '{"a": 2}' if "{broken" in prompt else "```json\n{}\n```" if "fenced" in prompt else "still none"
            return {"good ": '{"a": 1}', "fence": '```json\n{"a": 3}\n```', "broke": "{broken", "empty": "fenced?"}.get(prompt[:5], "none")

        return ask

    schema = T.StructType([T.StructField("a", T.LongType())])
    df = spark.createDataFrame([("good",), ("fence",), ("broke",), ("empty",), ("other",), ("fails",), (None,)], "p string")
    out = model.generate_object(df.repartition(2), F.col("p"), ModelSpec("m", factory), schema, ["a"])
    got = {r["p"]: (r["result"]["value"] and r["result"]["value"]["a"], r["result"]["error"]) for r in out.collect()}
    assert got["good"] == (1, None) and got["fence"] == (3, None) and got["broke"] == (2, None)
    assert got["empty"] == (None, "missing: a") and got["other"] == (None, "JSON is not in known format") and got["fails"] == (None, "ValueError: no")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and out.columns == ["p", "result"]


def messages(spark):
    return spark.createDataFrame(
        [(f"m{i}", "s", "a@b", f"2024-01-0{i}", "text " * i) for i in range(1, 8)],
        "id string, subject string, senders string, received_date string, content string",
    )


SETTINGS = {"categories_instructions": "c", "action_items_instructions": "a", "context_instructions": "x"}


def test_triage_twice_changes_nothing(spark, store):
    order = [F.col("received_date")]
    run = lambda **kw: jobs.mail_triage(store, messages(spark), SINGLE, SETTINGS, order, at(), **kw)
    run(limit=3)
    assert rows(store.read("mail_metadata"), "id") == [("m1",), ("m2",), ("m3",)]
    run(limit=None)
    first = rows(store.read("analysis"), "id", "category")
    run(limit=None)
    assert rows(store.read("analysis"), "id", "category") == first and len(first) == 7
    assert rows(store.read("mail_metadata"), "path")[0] == ("m1.msg",)


def test_placement_twice_places_once(spark, store):
    items = spark.createDataFrame(
        [("d1", 1, "High", "A", 1), ("d2", 2, "low", "B", 2), (None, 1, "high", "C", 3)], "analysis_id string, action_number int, priority string, title string, seq int"
    ).withColumns(
        {"doc_id": F.lit(1), "due_date": F.lit(None).cast("string"), "notes": F.lit(None).cast("string"), "links": F.lit(None).cast("array<struct<title:string,url:string>>")}
    )
    docs = spark.createDataFrame([(1, "body")], "doc_id int, text string")
    place = lambda p: jobs.place_todos(store, items, docs, F.lit("doc"), F.lit(5), [F.col("seq")], p).first()["text"]
    once = place("hi")
    assert once.startswith("body\n\U0001f534 A [") and "B" not in once
    assert rows(store.read("placement"), "analysis_id", "action_number", "placement_id") == [("d1", 1, "(None)")]
    assert place("hi") == "body"
    assert " B [" in place(".*")


def todos_of(spark, rows):
    links = {c: F.lit(None).cast("string") for c in ("due_date", "notes")} | {"links": F.lit(None).cast("array<struct<title:string,url:string>>")}
    return spark.createDataFrame(rows, "analysis_id string, action_number int, priority string, title string, seq int, doc_id int").withColumns(links)


def test_second_placement_keeps_the_first_ones_text(spark, store):
    items = todos_of(spark, [("d1", 1, "high", "A", 1, 1), ("d2", 2, "low", "B", 2, 1), ("d3", 1, "high", "C", 3, 2)])
    docs = spark.createDataFrame([(1, "body"), (2, "other")], "doc_id int, text string")
    place = lambda d, p: jobs.place_todos(store, items, d, F.lit("doc"), F.lit(1), [F.col("seq")], p)
    place(docs, "high")
    place(docs, ".*")
    text = {r["doc_id"]: r["text"] for r in store.read("edited").collect()}
    assert " A [" in text[1] and " B [" in text[1] and text[1].endswith("body") and text[2].count(" C [") == 1
    # a document handed in with another text is newer than what is stored
    more = items.unionByName(todos_of(spark, [("d4", 1, "high", "D", 4, 1)]))
    newer = docs.withColumn("text", F.when(F.col("doc_id") == 1, "rewritten").otherwise(F.col("text")))
    jobs.place_todos(store, more, newer, F.lit("doc"), F.lit(1), [F.col("seq")])
    assert store.read("edited").where("doc_id = 1").first()["text"].endswith(")\nrewritten") or " A [" not in store.read("edited").where("doc_id = 1").first()["text"]


def test_a_model_places_what_it_can(spark, store):
    def places():
        def ask(prompt):
            rows = json.JSONDecoder().raw_decode(prompt, prompt.index("[{"))[0]
            inserts = [{"index": 3 if r["title"] != "far" else 900, "content": r["title"], "origin_ids": [r["origin_id"]]} for r in rows if r["title"] != "left out"]
            inserts.append({"index": 1, "content": "?", "origin_ids": ["nobody|1"]})
            return json.dumps({"error": None, "inserts": inserts, "deletes": [{"start": 4, "end": 5, "origin_ids": ["d0|1"]}]})

        return ask

    rows = [(f"d{i}", 1, "high", t, i, 1) for i, t in enumerate(["A", "B", "far", "left out", "C", "D"])] + [("x", 1, "high", "E", 9, 7)]
    docs = spark.createDataFrame([(1, "1234567"), (2, "none")], "doc_id int, text string")
    run = lambda: jobs.place_todos(store, todos_of(spark, rows), docs, F.lit("doc"), F.lit(1), [F.col("seq")], limit=None, model=ModelSpec("places", places, "Stub"))
    out = {r["doc_id"]: r["text"] for r in run().collect()}
    # six items are two calls on the same text, each of which deletes the same character
    assert out[2] == "none" and out[1].startswith("??12DCBA3") and set(rows_of_ids(store, "placement")) == {"d0", "d1", "d4", "d5"}
    assert set(rows_of_ids(store, "unplaced")) == {"d2", "d3", "x"}
    run()
    assert set(rows_of_ids(store, "unplaced")) == {"d2", "d3", "x"} and store.read("placement").count() == 4


def rows_of_ids(store, name):
    return [r["analysis_id"] for r in store.read(name).collect()]


def test_failing_items_never_block_a_limit(spark, store):
    df = spark.createDataFrame([(i,) for i in range(6)], "id long")
    path, progress = work_dir(spark, "arrivals"), work_dir(spark, "progress")
    df.write.parquet(path)

    def process(new):
        bad = F.col("id") < 2
        return new.select("id", F.when(~bad, F.struct(F.col("id").alias("v"))).alias("value"), F.when(bad, "broken").alias("error"))

    job = stream_jobs.PolledJob(store, "out", "id", [F.col("id")], process, limit=2)
    tried = []
    for _ in range(4):
        job.finish(job.start(stream_jobs.file_stream(spark, path, df.schema), progress), df.schema)
        tried.append({r["id"] for r in store.read("out").collect()})
    assert tried == [set(), {2, 3}, {2, 3, 4, 5}, {2, 3, 4, 5}]
    assert {(r["id"], r["_attempts"]) for r in store.read("pending").collect()} == {(0, 2), (1, 2)}


def test_failing_mails_never_block_a_page(spark, store):
    def picky():
        def ask(prompt):
            if "id: m1\n" in prompt or "id: m2\n" in prompt:
                raise ValueError("no answer")
            return '{"category": "news", "action_items": []}'

        return ask

    run = lambda: jobs.mail_triage(store, messages(spark), ModelSpec("picky", picky, "Stub"), SETTINGS, [F.col("received_date")], at(), limit=2)
    assert {r["id"] for r in run().collect()} == {"m1", "m2"}
    for _ in range(3):
        run()
    assert store.read("mail_metadata").count() == 5
    assert {r["id"]: r["attempts"] for r in store.read("triage_attempts").collect()}.keys() == {"m1", "m2"}


def test_log_batches_go_on_from_the_head(spark, store):
    path = work_dir(spark, "arrivals")
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).selectExpr("'t' AS topic", "cast(id AS string) AS message", "id AS event").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    for _ in range(2):  # the second time from the start: its batches have been published
        stream = stream_jobs.file_stream(spark, path, schema, 1)
        stream_jobs.append_log(stream, store, "log", [F.col("event")], work_dir(spark, "progress")).awaitTermination()
    assert sorted(r["id"] for r in store.read("log").collect()) == list(range(1, 31))
    assert tuple(store.read("log_head").first()) == (2, 30)


def test_stream_equals_batch_and_repeats_are_harmless(spark, store):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "id long, v string")
    path = work_dir(spark, "arrivals")
    df.unionByName(df.limit(7)).repartition(4).write.parquet(path)

    def process(new):
        bad = F.col("id") % 10 == 9
        return new.select("id", F.when(~bad, F.struct("v")).alias("value"), F.when(bad, "nine").alias("error"))

    job = stream_jobs.PolledJob(store, "out", "id", [F.col("v")], process)
    for _ in range(2):  # the second time with a new checkpoint: all files come again
        stream = stream_jobs.file_stream(spark, path, df.schema, 1)
        job.finish(job.start(stream, work_dir(spark, "progress")))
    assert rows(store.read("out"), "id", "v") == [(i, f"v{i}") for i in range(40) if i % 10 != 9]
    assert {r["id"] for r in store.read("failures").collect()} == {9, 19, 29, 39}
    job.strict = True
    with pytest.raises(stream_jobs.FailedItems):
        job.finish(job.start(stream_jobs.file_stream(spark, path, df.schema), work_dir(spark, "progress")))


def test_polls_take_up_what_was_left_or_failed(spark, store):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "id long, v string")
    path, progress = work_dir(spark, "arrivals"), work_dir(spark, "progress")
    df.repartition(2).write.parquet(path)
    broken = {3, 7}

    def process(new):
        bad = F.col("id").isin(*broken) if broken else F.lit(False)
        return new.select("id", F.when(~bad, F.struct("v")).alias("value"), F.when(bad, "broken").alias("error"))

    job = stream_jobs.PolledJob(store, "out", "id", [F.col("v")], process, limit=5)

    def poll():
        job.finish(job.start(stream_jobs.file_stream(spark, path, df.schema), progress), df.schema)

    poll()
    assert store.read("out").count() == 4 and job.failed == ["broken"]
    for _ in range(6):
        poll()
    assert {r["id"] for r in store.read("pending").collect()} == broken
    broken.clear()
    poll()
    assert rows(store.read("out"), "id") == [(i,) for i in range(20)] and store.read("pending").count() == 0
    job.strict = True
    poll()  # failures of earlier runs are over


def test_saved_index_follows_every_change(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, subject string")
    b = a.where("id = '1'")
    path = work_dir(spark, "index")
    wrote = [exports.save_index(df, path, [F.col("id")]) for df in (a, a, b, a)]
    assert wrote == [True, False, True, True]
    assert rows(spark.read.schema(a.schema).json(path), "id") == [("1",), ("2",)]


def test_repeated_keys_are_stored_once(spark, store):
    twice = spark.createDataFrame([("i", "a", 1), ("i", "b", 1), ("j", None, 2)], "id string, v string, n int")
    merge.upsert(store, "t", twice, ["id"])
    assert rows(store.read("t"), "id", "n") == [("i", 1), ("j", 2)]
    merge.upsert(store, "t", twice, ["id"])
    merge.upsert(store, "t", twice.select("id", "v"), ["id"], [F.ascii("v")])
    assert [(r["id"], r["v"]) for r in store.read("t").orderBy("id").collect()] == [("i", "b"), ("j", None)]


def test_export_twice_writes_once(spark):
    root, index = work_dir(spark, "export"), work_dir(spark, "index")
    mail = messages(spark).withColumn("thread_id", F.lit("t")).withColumnRenamed("content", "body")
    jobs.export_mail(mail.limit(3), root, index, [F.col("id")])
    for _ in range(2):
        jobs.export_mail(mail, root, index, [F.col("id")])
    assert spark.read.parquet(root).count() == 7 and spark.read.json(index).count() == 7


def test_index_is_saved_while_mails_are_written(spark, monkeypatch):
    root, index = work_dir(spark, "export"), work_dir(spark, "index")
    mail = messages(spark).withColumn("thread_id", F.lit("t")).withColumnRenamed("content", "body")
    jobs.export_mail(mail.limit(1), root, index, [F.col("id")])
    saved = []
    monkeypatch.setattr(jobs, "save_index", lambda df, path, order, f=jobs.save_index: f(df, path, order) and saved.append(spark.read.json(path).count()))
    jobs.export_mail(mail, root, index, [F.col("id")], save_every=2)
    assert saved == [3, 5, 7] and spark.read.parquet(root).count() == 7


def test_todos_of_unknown_documents_wait(spark, store):
    items = spark.createDataFrame([("d1", 1, "High", "A", 1, 1), ("d2", 1, "High", "B", 2, 9)], "analysis_id string, action_number int, priority string, title string, seq int, doc_id int").withColumns(
        {"due_date": F.lit(None).cast("string"), "notes": F.lit(None).cast("string"), "links": F.lit(None).cast("array<struct<title:string,url:string>>")}
    )
    docs = spark.createDataFrame([(1, "one")], "doc_id int, text string")
    url = F.col("doc_id").cast("string")
    jobs.place_todos(store, items, docs, url, F.lit(1), [F.col("seq")])
    assert rows(store.read("placement"), "analysis_id") == [("d1",)] and rows(store.read("unplaced"), "doc_id") == [(9,)]
    assert " A [" in store.read("edited").first()["text"]
    more = docs.unionByName(spark.createDataFrame([(9, "nine")], docs.schema))
    jobs.place_todos(store, items, more, url, F.lit(1), [F.col("seq")])
    assert rows(store.read("placement"), "analysis_id") == [("d1",), ("d2",)] and store.read("unplaced").count() == 0


def test_long_recurrences_have_all_instances(spark):
    e = spark.createDataFrame([("a", 0, 10, "RRULE:FREQ=DAILY;COUNT=250000")], "id string, start_us long, end_us long, recurrence string")
    got = calendar.single_events(e).agg(F.count("*").alias("n"), F.count_distinct("start_us").alias("d"), F.max("instance").alias("m")).first()
    assert (got["n"], got["d"], got["m"]) == (250000, 250000, 249999)


def test_late_ids_are_delivered_once(spark):
    """Ids 5, 7 and 100, then 6 (and 7 again), then 1: each comes once, whenever it comes."""
    subs = spark.createDataFrame([("a", "t"), ("a", "u")], "agent string, topic string")
    schema = "topic string, id long, message string"
    path, target, progress = work_dir(spark, "arrivals"), work_dir(spark, "out"), work_dir(spark, "progress")
    seen = []
    for lot in ([("t", 7, "m7"), ("t", 5, "m5"), ("u", 100, "n"), ("t", 5, "again")], [("t", 6, "m6"), ("t", 7, "again")], [("t", 1, "m1"), ("t", 6, "again"), ("u", 99, "o")]):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(path)
        out = deliveries(stream_jobs.file_stream(spark, path, spark.createDataFrame([], schema).schema), subs).writeStream.format("parquet").option("path", target)
        out.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted((r["topic"], r["id"]) for r in spark.read.parquet(target).collect()))
    assert seen == [
        [("t", 5), ("t", 7), ("u", 100)],
        [("t", 5), ("t", 6), ("t", 7), ("u", 100)],
        [("t", 1), ("t", 5), ("t", 6), ("t", 7), ("u", 99), ("u", 100)],
    ]


def test_intervals_of_ids():
    rng = np.random.default_rng(3)
    had, low, high = set(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(200):
        ids = np.unique(rng.integers(0, 300, 6))
        assert unseen(ids, low, high).tolist() == [int(i) not in had for i in ids]
        low, high = with_ids(ids, low, high)
        had |= set(ids.tolist())
        assert sorted(had) == [x for a, b in zip(low, high) for x in range(a, b + 1)] and (low[1:] > high[:-1] + 1).all()


def test_saves_by_rows(spark, store):
    path = work_dir(spark, "arrivals")
    spark.range(25).selectExpr("id", "cast(id AS string) AS v").repartition(3).write.parquet(path)

    def process(df):
        bad = F.col("id") == 13
        return df.select("id", F.when(~bad, F.struct("v")).alias("value"), F.when(bad, "unlucky").alias("error"))

    job = stream_jobs.PolledJob(store, "out", "id", [F.col("v")], process, save_every=10)
    stream = stream_jobs.file_stream(spark, path, spark.read.parquet(path).schema)
    job.finish(job.start(stream, work_dir(spark, "progress")))
    assert job.saves == 3 and store.read("out").count() == 24
    assert [r["id"] for r in store.read("pending").collect()] == [13] == [r["id"] for r in store.read("failures").collect()]


def test_deliveries_and_timeout(spark):
    import time

    msgs = spark.createDataFrame([("t", 1, "m1"), ("t", 2, "m2"), ("u", 3, "m3")], "topic string, id long, message string")
    subs = spark.createDataFrame([("a", "t"), ("b", "t"), ("b", "u")], "agent string, topic string")
    path, target = work_dir(spark, "arrivals"), work_dir(spark, "out")
    msgs.repartition(1).write.parquet(path)
    stream = stream_jobs.file_stream(spark, path, msgs.schema)
    known = spark.createDataFrame([("a",), ("silent",)], "agent string")
    out = deliveries(stream, subs, timeout_ms=500, registered=known).writeStream.format("parquet").option("path", target)
    query = out.option("checkpointLocation", work_dir(spark, "progress")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(1)
            try:
                got = spark.read.parquet(target).collect()
            except Exception:  # nothing written yet
                continue
            if {r["agent"] for r in got if r["status"] == "timeout"} == {"a", "b", "silent"}:
                break
    finally:
        query.stop()
    assert sorted((r["agent"], r["id"]) for r in got if r["status"] == "message") == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)]
    assert sorted(r["agent"] for r in got if r["status"] == "timeout") == ["a", "b", "silent"]


def test_saves_do_not_rewrite_what_is_saved(spark, store):
    path = work_dir(spark, "arrivals")
    spark.range(200).selectExpr("id", "cast(id AS string) AS v").write.parquet(path)
    job = stream_jobs.PolledJob(store, "out", "id", [F.col("v")], lambda df: df.select("id", F.struct("v").alias("value"), F.lit(None).cast("string").alias("error")), save_every=10)
    job.finish(job.start(stream_jobs.file_stream(spark, path, spark.read.parquet(path).schema), work_dir(spark, "progress")))
    assert job.saves == 20 and sorted(r["id"] for r in store.read("out").collect()) == list(range(200))
    written = spark.read.option("recursiveFileLookup", "true").parquet(f"{store.root}/out").count()
    assert written == 200  # before, every save wrote the buckets of its rows anew


def _saved(spark, store, items, process, between=lambda n: None, **more):
    """The results of a job that saves by threes over items (id, v), with its saves."""
    path = work_dir(spark, "arrivals")
    spark.createDataFrame(items, "id long, v string").write.parquet(path)
    calls = []

    def counted(df):
        calls.append(1)
        between(len(calls))
        return process(df)

    job = stream_jobs.PolledJob(store, "out", "id", [F.col("v")], counted, save_every=3, **more)
    job.finish(job.start(stream_jobs.file_stream(spark, path, spark.read.parquet(path).schema), work_dir(spark, "progress")))
    return sorted((r["id"] if r["id"] is not None else -1, r["v"]) for r in store.read("out").collect()), job.saves


def _answers(df):
    return df.select("id", F.struct("v").alias("value"), F.lit(None).cast("string").alias("error"))


def test_saves_take_answers_over(spark, store, monkeypatch):
    compared = []
    for name in ("conflicts", "merged"):
        monkeypatch.setattr(merge, name, lambda *a, f=getattr(merge, name): compared.append(f.__name__) or f(*a))
    store.replace("out", spark.createDataFrame([(100, "old")], "id long, v string"), ["id"])
    got, saves = _saved(spark, store, [(i, f"v{i}") for i in range(20)] + [(None, "n")], _answers)
    assert not compared and saves == 7 and got == [(-1, "n"), *sorted((i, f"v{i}") for i in range(20)), (100, "old")]
    assert max(len(d) for d in store._latest()[1]["out"]["dirs"].values()) <= 16


def test_saves_of_many_parts_join_their_folders(spark, store):
    got, saves = _saved(spark, store, [(i, "v") for i in range(0, 240)], _answers)
    assert saves == 80 and [i for i, _ in got] == list(range(240))
    assert max(len(d) for d in store._latest()[1]["out"]["dirs"].values()) <= 16


@pytest.mark.parametrize("force_all", [False, True])
def test_saves_compare_answers_that_are_not_the_items_own(spark, store, force_all):
    store.replace("out", spark.createDataFrame([(1, "old"), (100, "old")], "id long, v string"), ["id"])

    def process(df):  # item 5 answers for 100, which is stored, 7 for 8, another item, and 9 twice; 6 fails, 10 is left out
        more = df.where("id = 9").select("id", F.lit("w9").alias("v"))
        rows = df.where("id <> 10").unionByName(more).withColumn("k", F.expr("CASE id WHEN 5 THEN 100 WHEN 7 THEN 8 ELSE id END"))
        error = F.when(F.col("id") == 6, "no")
        return rows.select(F.col("k").alias("id"), F.when(error.isNull(), F.struct("v")).alias("value"), error.alias("error"))

    got, saves = _saved(spark, store, [(i, f"v{i}") for i in range(12)], process, force_all=force_all)
    got = dict(got) if len(dict(got)) == len(got) else pytest.fail(f"keys came twice: {got}")
    assert saves == 4 and sorted(got) == [0, 1, 2, 3, 4, 8, 9, 11, 100]
    assert got[1] == ("v1" if force_all else "old") and got[100] == "v5" and got[9] == "w9" and got[8] in ("v7", "v8")
    assert [r["id"] for r in store.read("failures").collect()] == [6]


def test_saves_beside_another_writer(spark, store):
    """It publishes all keys after the first part: none is stored twice then."""
    other = lambda n: n == 2 and merge.upsert(store, "out", spark.createDataFrame([(i, "other") for i in range(9)], "id long, v string"), ["id"])
    got, saves = _saved(spark, store, [(i, f"v{i}") for i in range(9)], _answers, other)
    assert saves == 3 and [i for i, _ in got] == list(range(9)) and sorted(v == "other" for _, v in got) == [False] * 6 + [True] * 3


def test_rows_added_to_a_stored_table(spark, store):
    put = lambda rows, folders=16: (lambda txn: (merge.add_in(txn, store, "t", spark.createDataFrame(rows, "k long, v string"), ["k"], folders), txn.commit()))(store.begin())
    put([(1, "a"), (2, "b"), (2, "c"), (None, "n")])
    put([(2, "d"), (3, "e")])  # 2 is stored: an upsert
    put([(4, "f")])
    put([(5, "g"), (None, "m")], folders=1)  # buckets in one folder already are written anew
    assert rows(store.read("t"), "v", "k") == [("a", 1), ("d", 2), ("e", 3), ("f", 4), ("g", 5), ("m", None), ("n", None)]


def test_shuffles_start_with_partitions_to_join(spark):
    from officelake.session import prepare

    start, n = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, want in (("2", "32"), ("600", "1000"), ("2000", "2000")):  # before, no more than the session's number
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            prepare(spark)
            assert spark.conf.get(start) == want
        spark.conf.set(start, "5")  # its owner's
        prepare(spark)
        assert spark.conf.get(start) == "5"
    finally:
        spark.conf.unset(start)
        spark.conf.unset("officelake.initialPartitionNum")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        prepare(spark)
