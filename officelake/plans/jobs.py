"""End-to-end jobs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from officelake.functions.strings import split_modification_id, utf16_len
from officelake.functions.template import Template, todo_markdown, triage_prompt
from officelake.inference.model import (
    ANSWER_ROW,
    BATCH_SIZE,
    ModelSpec,
    classify_batches,
    generate_json,
    generate_object,
    joined_prompt,
    pin,
    refine,
)
from officelake.operators.edits import apply_edits, clamp, executed_ids, item_edits
from officelake.operators.filters import header_lines, matches_priority, numbered_url, route, unprocessed
from officelake.operators.lookups import match_back
from officelake.operators.ordering import batches, global_index, ordinal
from officelake.operators.rendering import markdown_pages
from officelake.schemas import ANALYSIS, LINKS
from officelake.session import pin_columns
from officelake.sinks.exports import mail_export_plan, save_index, write_messages
from officelake.sinks.merge import cascade_upsert, upsert, upsert_in
from officelake.sinks.store import TableStore
from officelake.sinks.sync import upsert_managed


ITEMS_PER_EDIT_CALL = 5  # fixed value: items of one call for edits
PLACE_INSTRUCTIONS = "Say where in the document below these items belong, as JSON with inserts and deletes."


def mail_metadata(messages: DataFrame) -> DataFrame:
    """Metadata rows of messages; ``path`` defaults to the id with ``.msg``."""
    optional = ["snippet", "recipients", "cc", "bcc"]
    have = [F.col(c) if c in messages.columns else F.lit(None).cast("string").alias(c) for c in optional]
    path = F.concat("id", F.lit(".msg"))
    if "path" in messages.columns:
        path = F.coalesce("path", path)
    return messages.select("id", path.alias("path"), "subject", "received_date", "senders", *have)


def render_todos(items: DataFrame, template: str | None = None, url: Column | None = None) -> DataFrame:
    """Action items with their markdown."""
    source_url = numbered_url(F.col("analysis_id"), F.col("action_number")) if url is None else url
    item = F.struct("priority", "title", source_url.alias("source_url"), "due_date", "notes", "links")
    return items.withColumn("markdown", todo_markdown(item, template))


def sheet_extract(
    books: DataFrame, text: str, keys: list[str], fields: list, row_number: str | None = None, accepted: int = 0
) -> DataFrame:
    """Spreadsheet JSON to one JSON text per used row, over all sheets and grids."""
    from officelake.operators import grid
    from officelake.sources.sheets import grid_rows, parse_spreadsheets

    keys = [*keys, "sheet", "grid"]
    rows = grid_rows(parse_spreadsheets(books, text))
    wide = grid.normalise(rows, keys, F.col("width"))
    # a book is one JSON text, so its grids are no longer than what came in as one row
    named = grid.to_fields(grid.used_rows(wide, keys, accepted, bounded=True), keys, fields, row_number)
    return named.select(F.to_json(F.struct(*([row_number] if row_number else []), *[f for f in fields if f])).alias("json"))


ACTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "notes", "priority", "due_date")] + [T.StructField("links", LINKS)]
)
ANALYSIS_ANSWER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("noteworthy_details", T.ArrayType(T.StringType())),
        T.StructField("action_items", T.ArrayType(ACTION)),
        T.StructField("people", ANALYSIS["people"].dataType),
        T.StructField("identifiers", ANALYSIS["identifiers"].dataType),
    ]
)


def analyse(messages: DataFrame, model: ModelSpec, settings: dict[str, Any]) -> DataFrame:
    """Messages (with ``content``) to nested sources, in struct<value, error> rows; a failing mail is one row."""
    headers = header_lines(
        id=F.col("id"), Subject=F.col("subject"), From=F.col("senders"), Received=F.col("received_date")
    )
    asked = generate_object(
        messages, triage_prompt(headers, F.col("content"), **settings), model, ANALYSIS_ANSWER, ["category"]
    )
    no_items = F.array().cast(T.ArrayType(ACTION))
    analysis = F.struct(
        F.col("result.value.category").alias("category"),
        F.col("result.value.noteworthy_details").alias("noteworthy_details"),
        F.coalesce("result.value.action_items", no_items).alias("action_items"),
        F.col("result.value.people").alias("people"),
        F.col("result.value.identifiers").alias("identifiers"),
    )
    return asked.select(
        "id",
        F.when(F.col("result.error").isNull(), analysis).alias("analysis"),
        F.col("result.error").alias("error"),
    )


def mail_triage(
    store: TableStore,
    messages: DataFrame,
    model: ModelSpec,
    settings: dict[str, Any],
    order: list[Column],
    now: Column,
    limit: int | None = 30,
    force_all: bool = False,
) -> DataFrame:
    """Analyse mails that have no metadata yet and store source, analysis, items, metadata and message at once.

    The anti-join and the limit come before anything that reads bodies or calls the model. Mails that failed come
    after all others at the next run, the less often failed ones first. Returns the failures; the model's answers are
    pinned, so storing them asks for none again.
    """
    fresh = messages
    if store.exists("mail_metadata"):
        fresh = unprocessed(messages, store.read("mail_metadata"), "id", force_all)
    before = store.read("triage_attempts") if store.exists("triage_attempts") else None
    if limit is not None:
        if before is not None:
            fresh = fresh.join(before, "id", "left")
            fresh = fresh.orderBy(F.coalesce("attempts", F.lit(0)), *order).limit(limit).drop("attempts")
        else:
            fresh = fresh.orderBy(*order).limit(limit)
        # pinned: the page must be the same wherever it is read
        fresh = pin(fresh)
    answered = pin(analyse(fresh, model, settings))
    good = answered.where(F.col("error").isNull())
    facts = mail_metadata(fresh).select("id", F.struct("*").alias("mail_metadata"))
    data = fresh.select("id", F.struct("id", F.col("content").alias("raw")).alias("mail_data"))
    nested = good.select("id", F.lit("mail").alias("type"), now.alias("created_time"), "analysis")
    failed = answered.where(F.col("error").isNotNull()).select("id", "error")
    txn = store.begin()
    cascade_upsert(store, pin(nested.join(facts, "id").join(data, "id")), txn)
    tries = failed.select("id", F.lit(1).alias("attempts"))
    if before is not None:
        tries = before.join(good.select("id"), "id", "left_anti").unionByName(tries).groupBy("id").agg(F.sum("attempts").cast("int").alias("attempts"))
    txn.replace("triage_attempts", tries)
    txn.commit()
    return failed


def place_todos(
    store: TableStore,
    items: DataFrame,
    documents: DataFrame,
    container: Column,
    index: Column,
    order: list[Column],
    priority: str = ".*",
    limit: int | None = 5,
    template: str | None = None,
    model: ModelSpec | None = None,
    instructions: str = PLACE_INSTRUCTIONS,
) -> DataFrame:
    """Insert to-dos not placed yet into their documents (``doc_id`` of an item) and record the placements.

    To-dos go to ``index``, or, with a ``model``, to where it says, which may also delete ranges. Returns the documents
    as given, those edited in this run with all their edits; these are stored in the table ``edited`` in the same
    publication as the placements. A document handed in as it was when it was first edited is taken as stored, so that
    a later run adds to what an earlier one has written; one handed in with another text is newer and taken as it is.

    To-dos of documents that are not there, and those a model gave no usable edit for, are no placements: they are left
    in the table ``unplaced`` and tried again next time. ``container`` gives the document's URL from ``doc_id``.
    """
    items = items.withColumn("placement_container_url", container).where(F.col("analysis_id").isNotNull())
    key = ["analysis_id", "action_number", "placement_container_url"]
    fresh = items.where(matches_priority(priority))
    if store.exists("placement"):
        done = store.read("placement").where(F.col("placement_id") == "(None)")
        fresh = fresh.join(done.select(*key), key, "left_anti")
    if limit is not None:
        fresh = fresh.orderBy(*order).limit(limit)
    # only what is rendered and recorded, as columns
    fresh = pin_columns(fresh.select(*dict.fromkeys(["doc_id", *key[:2], "seq", "priority", "title", "due_date", "notes", "links"])))
    fresh = fresh.withColumn("placement_container_url", container)
    known = fresh.join(documents.select("doc_id"), "doc_id", "left_semi")
    current = _as_stored(store, documents, known)
    todos = render_todos(known, template)
    edits = item_edits(todos, index, F.col("markdown"), F.col("seq")) if model is None else _model_item_edits(todos, current, instructions, model)
    edited = pin_columns(apply_edits(current, edits, "_edited"))
    placed = executed_ids(edits).select(container.alias("placement_container_url"), split_modification_id(F.col("origin_id")).alias("p"))
    rows = placed.where(F.col("p").isNotNull()).select("p.analysis_id", "p.action_number", "placement_container_url", "p.placement_id")
    if model is not None:  # it may name items that nobody asked for
        rows = rows.join(known.select(*key), key, "left_semi")
    if model is not None or store.exists("placement"):  # a merge reads them more than once
        rows = pin_columns(rows)
    txn = store.begin()
    upsert_in(txn, store, "placement", rows, [*key, "placement_id"])
    written = edited.where("_edited").drop("_edited")
    upsert_in(txn, store, "edited", written.join(documents.select("doc_id", F.md5("text").alias("base_hash")), "doc_id"), ["doc_id"])
    lost = fresh.join(documents.select("doc_id"), "doc_id", "left_anti") if model is None else fresh.join(rows.select(*key), key, "left_anti")
    txn.replace("unplaced", lost.select("doc_id", *key))
    txn.commit()
    return edited.drop("_edited")


def _as_stored(store: TableStore, documents: DataFrame, known: DataFrame) -> DataFrame:
    """``documents`` with the stored text of those that have to-dos now and were handed in before with the same text."""
    if not store.exists("edited"):
        return documents
    saved = store.read("edited", store.buckets_of("edited", known)).join(known.select("doc_id"), "doc_id", "left_semi")
    saved = saved.select("doc_id", F.col("text").alias("_saved"), "base_hash")
    text = F.when(F.col("base_hash") == F.md5("text"), F.col("_saved")).otherwise(F.col("text"))
    return documents.join(saved, "doc_id", "left").withColumn("text", text).select(*documents.columns)


def _model_item_edits(items: DataFrame, documents: DataFrame, instructions: str, model: ModelSpec, size: int = ITEMS_PER_EDIT_CALL) -> DataFrame:
    """Edits a model proposes for a document's items, ``size`` of them a call, all calls on the same text."""
    origin = F.concat_ws("|", F.col("analysis_id").cast("string"), F.col("action_number").cast("string"))
    numbered = ordinal(items.withColumn("origin_id", origin), ["doc_id"], [F.col("seq")], "_n")
    item = F.struct("_n", "origin_id", "action_number", "title", "markdown")
    grouped = numbered.groupBy("doc_id", F.expr(f"_n div {size}").alias("part")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    grouped = grouped.join(documents.select("doc_id", "text"), "doc_id")
    batch = F.struct("doc_id", "part", (utf16_len(F.col("text")) + 1).cast("long").alias("end"))
    asked = F.transform("items", lambda i: i.dropFields("_n"))
    prompt = F.concat(F.lit(instructions + "\n"), F.to_json(asked), F.lit("\nDocument:\n"), F.col("text"))
    edits, _ = model_edits(grouped.withColumn("batch", batch), prompt, model, F.col("batch.end"))
    seq = F.struct("batch.part", "at", "kind")
    return pin(edits.where(F.col("error").isNull()).select("batch.doc_id", seq.alias("seq"), "kind", "index", "end", "content", "origin_ids"))


def categorise(
    index: DataFrame,
    done: DataFrame,
    order: list[Column],
    prompt: Column,
    model: ModelSpec,
    refine_prompt: Column | None = None,
    refine_model: ModelSpec | None = None,
    refine_categories: tuple[str, ...] = ("unknown", "other"),
    size: int = BATCH_SIZE,
) -> DataFrame:
    """Categories of the index rows that have none, in batches, with a second look at the vague ones.

    A failed batch fails the job. ``prompt`` is built from the ``items`` of a batch, ``refine_prompt`` from a
    row with its category.
    """
    pending = unprocessed(index, done)
    found, _, failed = classify_batches(batches(pending.select("id", "n_chars"), order, size), pending, prompt, model)
    first = failed.first()
    if first is not None:
        raise RuntimeError(f"batch {first['batch']} failed: {first['error']}")
    if refine_prompt is not None:
        schema = T.StructType([T.StructField("category", T.StringType())])

        def second(rows: DataFrame) -> DataFrame:
            return refine(rows, refine_prompt, refine_model or model, schema, ["category"]).drop("refine_error")

        found = route(found, "category", list(refine_categories), second)
    return found


def export_mail(messages: DataFrame, root: str, index_path: str, order: list[Column], save_every: int | None = None) -> DataFrame:
    """Write the mails that aren't exported yet and save the index of all that are; returns its rows.

    What exists is read from the folder itself (paths only, before anything is written), so an export that broke off
    before its index goes on where it stopped, and a second one writes nothing. With ``save_every`` the mails are
    written so many at a time, and the index is saved after each time.
    """
    from officelake.sources.mailbox import path_exists

    spark = messages.sparkSession
    existing = spark.read.schema("path string, content string").parquet(root).select("path") if path_exists(spark, root) else None
    # pinned: what exists is looked up before the folder is written to
    existing = pin(existing) if existing is not None else messages.limit(0).select(F.lit("").alias("path"))
    plan = mail_export_plan(messages, existing)
    plan = pin(plan if save_every is None else global_index(plan, order, "_place"))
    whole = mail_export_plan(messages)

    def save(written: DataFrame) -> DataFrame:
        index = mail_metadata(whole.join(existing.unionByName(written.select("path")), "path", "left_semi"))
        save_index(index, index_path, order)
        return index

    if save_every is None:
        write_messages(plan, root)
        return save(plan)
    index = None
    for start in range(0, max(1, plan.count()), save_every):
        write_messages(plan.where((F.col("_place") >= start) & (F.col("_place") < start + save_every)), root)
        index = save(plan.where(F.col("_place") < start + save_every))
    return index


def todos_to_tasks(
    pages: DataFrame, html: str, key: str, model: ModelSpec, stored: DataFrame, order: list[Column]
) -> DataFrame:
    """To-dos a model finds in HTML documents, synced as managed tasks.

    Pages without text, and those a model gave no usable answer for, are rows with the action ``error`` and an ``error``.
    """
    read = pin_columns(markdown_pages(pages, key, html))  # read twice
    prompt = F.concat(F.lit("id: "), F.col(key).cast("string"), F.lit("\n"), F.col("value"))
    answered = pin(generate_json(read.where(F.col("error").isNull()).drop("error"), joined_prompt(model, prompt), model).select(key, "result"))
    url = F.concat(F.lit("http://pages/"), F.col(key).cast("string"))
    tasks = answered.where(F.col("result.error").isNull()).select(
        url.alias("id_url"),
        F.concat(F.lit("Read: "), F.get_json_object("result.json", "$.category")).alias("title"),
        F.lit(None).cast("string").alias("tasklist_id"),
        F.lit(None).cast("string").alias("notes"),
        F.lit("needsAction").alias("status"),
    )
    failed = answered.where(F.col("result.error").isNotNull()).select(key, F.col("result.error").alias("error"))
    failed = failed.unionByName(read.where(F.col("error").isNotNull()).select(key, "error"))
    synced = upsert_managed(tasks, stored, order).withColumn("error", F.lit(None).cast("string"))
    return synced.unionByName(failed.select(url.alias("id_url"), F.array(F.lit("error")).alias("actions"), "error"), allowMissingColumns=True)


CHECK_TEMPLATE = """\
id: {{ name }}
Check the document below and suggest improvements as JSON.

{{ text }}
"""


def self_check(documents: DataFrame, checked: DataFrame, model: ModelSpec) -> DataFrame:
    """Suggestions for documents whose content has changed since they were checked (doc_id, content_hash)."""
    hashed = documents.withColumn("content_hash", F.md5("text"))
    changed = hashed.join(checked.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")
    prompt = Template(CHECK_TEMPLATE).render(name=F.col("doc_id"), text=F.col("text"))
    return generate_object(changed, prompt, model, ANSWER_ROW, ["id"])


INSERTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("index", T.LongType()),
            T.StructField("content", T.StringType()),
            T.StructField("origin_ids", T.ArrayType(T.StringType())),
        ]
    )
)
DELETES = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("origin_ids", T.ArrayType(T.StringType())),
        ]
    )
)
UPDATE = T.StructType(
    [T.StructField("error", T.StringType()), T.StructField("inserts", INSERTS), T.StructField("deletes", DELETES)]
)


def model_edits(grouped: DataFrame, prompt: Column, model: ModelSpec, end: Column) -> tuple[DataFrame, DataFrame]:
    """Edits a model proposes for batches of items, clamped to a document ending at ``end``; and failures."""
    asked = pin(generate_object(grouped, prompt, model, UPDATE, []).select("batch", "result"))
    error = F.coalesce("result.error", "result.value.error")
    good = asked.where(error.isNull())
    deletes = good.select("batch", F.posexplode("result.value.deletes").alias("at", "e")).select(
        "batch", "at", F.lit("delete").alias("kind"), F.col("e.start").alias("index"), "e.end", "e.origin_ids"
    )
    inserts = good.select("batch", F.posexplode("result.value.inserts").alias("at", "e")).select(
        "batch", "at", F.lit("insert").alias("kind"), "e.index", F.lit(None).cast("long").alias("end"), "e.origin_ids", "e.content"
    )
    edits = clamp(deletes.unionByName(inserts, allowMissingColumns=True), end)
    return edits, asked.where(error.isNotNull()).select("batch", error.alias("error"))


def categorise_and_store(
    store: TableStore, documents: DataFrame, done: DataFrame, model: ModelSpec, limit: int | None = None
) -> DataFrame:
    """The smallest whole job: scan, anti-join, prompt, model, decode, last-wins, merge.

    Rows without a usable answer are in the table ``failures`` and stay fresh for the next run.
    """
    fresh = unprocessed(documents, done)
    if limit is not None:
        fresh = fresh.orderBy("id").limit(limit)
    prompt = Template("id: {{ id }}\n{{ text }}").render(id=F.col("id"), text=F.col("text"))
    answered = pin(generate_json(fresh, joined_prompt(model, prompt), model).select("id", "result"))  # asked once
    rows = answered.select(
        F.get_json_object("result.json", "$.id").alias("id"), F.get_json_object("result.json", "$.category").alias("category")
    )
    matched, _ = match_back(rows.where(F.col("id").isNotNull()), fresh.select("id"))
    upsert(store, "results", matched, ["id"], [F.col("category")])
    failed = fresh.select("id").join(matched.select("id"), "id", "left_anti")
    store.replace("failures", failed.join(answered.select("id", F.col("result.error").alias("error")), "id", "left"))
    return store.read("results")
