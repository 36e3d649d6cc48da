"""Bindings: model calls (with the deterministic stub) and the result cache."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from officelake.catalog import query
from officelake.catalog.functions import prompt_hash_sql
from officelake.inference import cache, model
from officelake.inference.stub import LISTS, SINGLE, weight
from officelake.operators.filters import route, unprocessed
from officelake.operators.ordering import batches, last_wins
from officelake.plans import inputs
from officelake.plans.inputs import CATEGORIES_SQL, table
from officelake.session import work_dir
from officelake.sinks.store import TableStore

CATEGORY_SQL = "['useful', 'unknown', 'other', 'news', 'spam'][{n} % 5 + 1]"


def weight_sql(text: str) -> str:
    """The stub's weight of a prompt, as SQL."""
    return f"(length({text}) + 31 * (length({text}) - length(replace({text}, 'e', ''))))"


def answer_sql(id_json: str, n: str) -> str:
    """The stub's answer to a prompt of weight n."""
    full = f"""'{{"id": ' || {id_json} || ', "category": "' || {CATEGORY_SQL.format(n=n)} || '"}}'"""
    broken = f"CASE WHEN {n} % 7 = 0 THEN left({full}, -1) ELSE {full} END"
    return f"CASE WHEN {n} % 3 = 0 THEN '```json' || chr(10) || {broken} || chr(10) || '```' ELSE {broken} END"


def _prompt():
    return F.concat(F.lit("id: "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))


PROMPT_WEIGHT_SQL = weight_sql("('id: ' || doc_id || chr(10) || text)")
PROMPTS_SQL = f"p AS (SELECT doc_id, {PROMPT_WEIGHT_SQL} AS size FROM documents)"


@query(
    "m1_generate_text",
    f"""WITH {PROMPTS_SQL}, q AS (SELECT doc_id, size + 3 AS n FROM p)
        SELECT doc_id, {answer_sql("'" + '"' + "' || doc_id || '" + '"' + "'", 'n')} AS answer, CAST(NULL AS VARCHAR) AS error FROM q""",
)
def m1(spark, sf):
    prompt = model.joined_prompt(SINGLE, _prompt(), F.lit("##"))
    out = table(spark, sf, "documents").select("doc_id", model.generate_text(prompt, SINGLE).alias("r"))
    return out.select("doc_id", F.col("r.value").alias("answer"), "r.error")


@query(
    "m2_generate_json",
    f"""WITH {PROMPTS_SQL}, q AS (SELECT doc_id, size AS n FROM p)
        SELECT doc_id, {CATEGORY_SQL.format(n='n')} AS category, CAST(NULL AS VARCHAR) AS error FROM q""",
)
def m2(spark, sf):
    d = table(spark, sf, "documents")
    out = model.generate_json(d, model.joined_prompt(SINGLE, _prompt()), SINGLE)
    return out.select("doc_id", F.get_json_object("result.json", "$.category").alias("category"), "result.error")


INSTRUCTIONS_SIZE = weight(model.object_instructions(model.ANSWER_ROW)) + 1


@query(
    "m3_generate_object",
    f"""WITH {PROMPTS_SQL}, q AS (SELECT doc_id, size + {INSTRUCTIONS_SIZE} AS n FROM p)
        SELECT CAST(doc_id AS VARCHAR) AS id, {CATEGORY_SQL.format(n='n')} AS category, CAST(NULL AS VARCHAR) AS error FROM q""",
)
def m3(spark, sf):
    d = table(spark, sf, "documents")
    out = model.generate_object(d, _prompt(), SINGLE, model.ANSWER_ROW, ["id", "category"])
    return out.select("result.value.*", "result.error")


def _pending(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "n_chars", "text")
    done = inputs.categories(spark, sf).select(F.col("id").cast("string").alias("id"))
    return unprocessed(d, done)


def classify_prompt():
    """One prompt per batch, the rows as a JSON array in the last line."""
    rows = F.transform("items", lambda i: F.struct(i["id"].alias("id"), i["n_chars"].alias("n_chars")))
    return F.concat(F.lit("Give every row a category.\n"), F.to_json(rows))


@query(
    "m5_batched_classification",
    f"""SELECT CAST(doc_id AS VARCHAR) AS id, {CATEGORY_SQL.format(n='n_chars')} AS category FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def m5(spark, sf):
    rows = _pending(spark, sf).select("id", "n_chars")
    grouped = batches(rows, [F.col("id")], model.BATCH_SIZE)
    matched, _, _ = model.classify_batches(grouped, rows, classify_prompt(), LISTS)
    return matched.select("id", "category")


@query(
    "m6_refinement",
    f"""WITH {CATEGORIES_SQL}, q AS (SELECT c.id, c.category, {PROMPT_WEIGHT_SQL} AS n
            FROM categories c JOIN documents ON doc_id = c.id)
        SELECT id, CASE WHEN category IN ('unknown', 'other') THEN {CATEGORY_SQL.format(n='n')} ELSE category END AS category FROM q""",
)
def m6(spark, sf):
    schema = T.StructType([T.StructField("category", T.StringType())])
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "doc_id", "text")
    rows = inputs.categories(spark, sf).join(d, "id")

    def second(df):
        out = model.refine(df, model.joined_prompt(SINGLE, _prompt()), SINGLE, schema, ["category"])
        return out.drop("refine_error")

    return route(rows, "category", ["unknown", "other"], second).select("id", "category")


@query(
    "c2_cached_call",
    f"""WITH q AS (SELECT conv_id, turn, text, {weight_sql('text')} AS n FROM conversations)
        SELECT conv_id, turn, {answer_sql("'null'", 'n')} AS value,
        {prompt_hash_sql('text')} AS args_hash, 'Stub_query(single)' AS reg_key FROM q""",
)
def c2(spark, sf):
    store = TableStore(spark, work_dir(spark, "cache"))
    c = table(spark, sf, "conversations")
    now = F.lit("2024-02-01").cast("timestamp")
    cache.cached_call(store, "calls", c.where("role <> 'assistant'"), F.col("text"), SINGLE, now)
    out = cache.cached_call(store, "calls", c, F.col("text"), SINGLE, now)
    return out.select("conv_id", "turn", "value", "args_hash", "reg_key")


@query(
    "c3_cache_stats_by_model",
    "SELECT 'Stub_query(single)' AS reg_key, count(DISTINCT text) AS calls FROM conversations",
)
def c3(spark, sf):
    store = TableStore(spark, work_dir(spark, "cache"))
    c = table(spark, sf, "conversations")
    # Asked in two runs; what both ask for is called once.
    cache.cached_call(store, "calls", c.where("turn < 3"), F.col("text"), SINGLE, F.lit("2024-02-01").cast("timestamp"))
    cache.cached_call(store, "calls", c, F.col("text"), SINGLE, F.lit("2024-02-02").cast("timestamp"))
    return cache.stats(store.read("calls")).select("reg_key", "calls")


def _calls(spark, sf):
    e = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    rows = e.select(
        F.col("event_type").alias("reg_key"),
        F.md5(F.col("user_id").cast("string")).alias("args_hash"),
        F.col("user_id").cast("string").alias("serialized_args"),
        F.col("props").alias("value"),
        ts.alias("added"),
        F.timestamp_micros(F.unix_micros(ts) + F.round(F.col("value") * 60000000).cast("long")).alias("accessed"),
    )
    return last_wins(rows, cache.KEY, [F.col("added"), F.col("value")])


CALLS_SQL = """calls AS (SELECT event_type AS reg_key, md5(CAST(user_id AS VARCHAR)) AS args_hash, max(ts) AS added,
     arg_max(props, (ts, props)) AS value, arg_max(user_id, (ts, props)) AS serialized_args,
     make_timestamp(arg_max(epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT), (ts, props))) AS accessed FROM events GROUP BY 1, 2)"""


@query(
    "c1_add_get_remove",
    f"""WITH {CALLS_SQL} SELECT reg_key, args_hash, CASE WHEN reg_key = 'view' THEN 'new' ELSE value END AS value
        FROM calls WHERE reg_key <> 'error'""",
)
def c1(spark, sf):
    calls = _calls(spark, sf)
    new = calls.where("reg_key = 'view'").withColumn("value", F.lit("new"))
    kept = cache.remove(cache.add(calls, new), calls.where("reg_key = 'error'"))
    return cache.get(kept, calls.where("reg_key <> 'error'").select(*cache.KEY))


@query(
    "j11_cache_probe",
    f"""WITH {CALLS_SQL} SELECT event_id, event_type AS reg_key, md5(CAST(user_id AS VARCHAR)) AS args_hash, c.value
        FROM events e LEFT JOIN calls c ON c.reg_key = e.event_type AND c.args_hash = md5(CAST(e.user_id AS VARCHAR)) AND c.reg_key <> 'click'""",
)
def j11(spark, sf):
    keys = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("reg_key"), F.md5(F.col("user_id").cast("string")).alias("args_hash")
    )
    return cache.get(_calls(spark, sf).where("reg_key <> 'click'"), keys)


@query("c4_prefix_view", f"WITH {CALLS_SQL} SELECT reg_key, args_hash FROM calls WHERE reg_key <> 'view'")
def c4(spark, sf):
    calls = _calls(spark, sf)
    both = cache.with_prefix(calls.where("reg_key <> 'view'"), "a/").unionByName(
        cache.with_prefix(calls.where("reg_key = 'view'"), "b/")
    )
    return cache.prefix_view(both, "a/").select("reg_key", "args_hash")


PURGE = {
    "default_access": 20 * 86400.0,
    "default_added": 25 * 86400.0,
    "prefix_ages": [("click", None, 86400.0), ("c", 0.0, 0.0), ("err", 3600.0 * 12, None)],
}


@query(
    "c5_purge",
    f"""WITH {CALLS_SQL} SELECT reg_key, args_hash FROM calls WHERE
        accessed >= TIMESTAMP '2024-01-30' - CASE WHEN reg_key = 'error' THEN INTERVAL 12 HOURS ELSE INTERVAL 20 DAYS END
        AND added >= TIMESTAMP '2024-01-30' - CASE WHEN reg_key = 'click' THEN INTERVAL 1 DAY ELSE INTERVAL 25 DAYS END""",
)
def c5(spark, sf):
    return cache.purge(_calls(spark, sf), F.lit("2024-01-30").cast("timestamp"), **PURGE).select("reg_key", "args_hash")


STATS_SQL = "count(*) AS calls, min(accessed) AS first_accessed, max(accessed) AS last_accessed"


@query("a6_cache_stats", f"WITH {CALLS_SQL} SELECT reg_key, {STATS_SQL} FROM calls GROUP BY reg_key")
def a6(spark, sf):
    return _naive(cache.stats(_calls(spark, sf)))


def _naive(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_accessed", "last_accessed")})


@query(
    "c6_stats_and_args",
    f"WITH {CALLS_SQL} SELECT reg_key, args_hash, CAST(serialized_args AS VARCHAR) AS serialized_args FROM calls",
)
def c6(spark, sf):
    return _calls(spark, sf).select("reg_key", "args_hash", "serialized_args")


@query(
    "c7_load_and_store",
    f"""WITH {CALLS_SQL} SELECT reg_key, {STATS_SQL} FROM calls WHERE accessed >= TIMESTAMP '2024-01-30' - INTERVAL 5 DAYS GROUP BY reg_key""",
)
def c7(spark, sf):
    store = TableStore(spark, work_dir(spark, "cache"))
    calls, at = _calls(spark, sf), F.lit("2024-01-30").cast("timestamp")
    empty = cache.load(store, "calls", at, calls.limit(0))
    cache.save(store, "calls", cache.add(empty, calls), at, default_access=10 * 86400.0)
    return _naive(cache.stats(cache.load(store, "calls", at, empty, default_access=5 * 86400.0)))
