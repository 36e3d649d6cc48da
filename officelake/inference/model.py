"""Model calls over tables: text, JSON with one repair, typed objects, batches and refinement."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from officelake.functions.html import VALUE_OR_ERROR
from officelake.functions.jsons import checked, decode_json, json_text, parsed, typed
from officelake.operators.lookups import match_back

ATTEMPTS, FIRST_DELAY, FACTOR = 3, 10.0, 2.0  # fixed values: retries of a failing call
BATCH_SIZE = 20  # fixed value: rows in one classification prompt
PARALLEL = 5  # fixed value: calls under way


class RetryableError(RuntimeError):
    """A failure of the model service that may pass."""


def whole(text: Column) -> Column:
    """The text as it is."""
    return text


@dataclass(frozen=True)
class ModelSpec:
    """A model by name. ``factory`` makes the client, once per task and in the task.

    Models see whole texts; pass ``truncate_prompt`` or another ``preprocess`` to have prompts cut.
    """

    name: str
    factory: Callable[[], Callable[[str], str]]
    kind: str = "Model"
    preprocess: Callable[[Column], Column] = whole

    @property
    def cache_key(self) -> str:
        """Key of this model's calls in the result cache."""
        return f"{self.kind}_query({self.name})"


def _ask(client: Callable[[str], str], prompt: str, attempts: int, delay: float, factor: float):
    for attempt in range(attempts):
        try:
            return client(prompt), None
        except RetryableError as e:
            if attempt + 1 == attempts:
                return None, f"{type(e).__name__}: {e}"
            time.sleep(delay)
            delay *= factor
        except Exception as e:  # a failing row must not fail the others
            return None, f"{type(e).__name__}: {e}"


def generate_text(
    prompt: Column,
    model: ModelSpec,
    attempts: int = ATTEMPTS,
    delay: float = FIRST_DELAY,
    factor: float = FACTOR,
    parallel: int = PARALLEL,
) -> Column:
    """struct<value, error> of one call per row; only the prompt column travels to Python.

    A task has up to ``parallel`` calls under way and only their prompts as Python texts, however many rows come at once,
    so a call that waits to be tried again holds up none of the others;
    a client has to stand being called from several threads. Null prompts make no call. The function counts as nondeterministic, so that no rewrite of the plan
    repeats a call.
    """
    factory = model.factory

    @F.arrow_udf(VALUE_OR_ERROR)
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = factory()

        def answer(prompts: pa.Array, places: Iterator[int], value: list, error: list) -> None:
            for i in places:  # shared by the threads: whoever is free takes the next one
                prompt = prompts[i].as_py()
                if prompt is not None:
                    value[i], error[i] = _ask(client, prompt, attempts, delay, factor)

        with ThreadPoolExecutor(max_workers=parallel) as pool:
            for prompts in batches:
                value, error, places = [None] * len(prompts), [None] * len(prompts), iter(range(len(prompts)))
                for done in [pool.submit(answer, prompts, places, value, error) for _ in range(parallel)]:
                    done.result()
                yield pa.StructArray.from_arrays([pa.array(value, pa.string()), pa.array(error, pa.string())], ["value", "error"])

    return call.asNondeterministic()(prompt)


def joined_prompt(model: ModelSpec, *parts: Column) -> Column:
    """Prompt parts, each as the model wants them, in one text."""
    return F.concat_ws(" ", *[model.preprocess(p) for p in parts])


REPAIR_INTRO = "This text should be one valid JSON value. Correct it without changing its content and reply with the JSON only."
RULE = "-" * 28


def repair_prompt(answer: Column) -> Column:
    """The prompt asking to correct an answer that is no JSON."""
    return F.concat(F.lit(f"{REPAIR_INTRO}\n{RULE}\n"), answer, F.lit(f"\n{RULE}\n"))


def generate_json(df: DataFrame, prompt: Column, model: ModelSpec, name: str = "result") -> DataFrame:
    """Adds struct<json, error>: the JSON text of the answer, after one repair call where it was none."""
    first = df.withColumn("_first", generate_text(prompt, model)).withColumn("_json_text", json_text(F.col("_first.value")))
    first = first.withColumn("_ok", F.col("_first.value").isNull() | F.try_parse_json("_json_text").isNotNull())
    broken = F.when(~F.col("_ok"), model.preprocess(repair_prompt(F.col("_first.value"))))
    second = first.withColumn("_second", generate_text(broken, model))
    # a good first answer is not taken apart again; what is used twice is a column of its own, or each use computes it
    repaired = json_text(F.col("_second.value"))
    second = second.withColumn("_json_text", F.when(F.col("_ok"), F.col("_json_text")).otherwise(repaired))
    wrong = F.when(~F.col("_ok"), decode_json(F.col("_second.value"))["error"])
    second = second.withColumn("_failure", F.coalesce(F.col("_first.error"), F.col("_second.error"), wrong))
    result = F.struct(F.when(F.col("_failure").isNull(), F.col("_json_text")).alias("json"), F.col("_failure").alias("error"))
    return second.withColumn(name, result).drop("_first", "_ok", "_second", "_json_text", "_failure")


def sample_of(kind: T.DataType):
    """An example value of a type, for the instructions of a prompt."""
    if isinstance(kind, T.StructType):
        return {f.name: sample_of(f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [sample_of(kind.elementType)]
    if isinstance(kind, T.BooleanType):
        return True
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return 1
    return 1.5 if isinstance(kind, (T.DoubleType, T.FloatType)) else "text"


def object_instructions(schema: T.StructType) -> str:
    """What is added to a prompt to get an object of the schema."""
    return f"Answer with valid JSON in double quotes only, built like this sample:\n```\n{json.dumps(sample_of(schema))}\n```\n"


def generate_object(
    df: DataFrame, prompt: Column, model: ModelSpec, schema: T.StructType, required: list[str], name: str = "result"
) -> DataFrame:
    """Adds struct<value, error>: the answer as a typed object."""
    full = joined_prompt(model, prompt, F.lit(object_instructions(schema)))
    out = generate_json(df, full, model, "_json")
    out = out.withColumn("_object", parsed(F.col("_json.json"), schema))  # a column of its own is parsed once
    obj = checked(F.col("_object"), schema, required)
    error = F.coalesce(F.col("_json.error"), obj["error"])
    return out.withColumn(name, F.struct(obj["value"].alias("value"), error.alias("error"))).drop("_json", "_object")


ANSWER_ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("category", T.StringType())])


def classify_batches(
    batches: DataFrame, rows: DataFrame, prompt: Column, model: ModelSpec
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One call per batch of ``items``; returns (classified rows, unknown answers, failed batches).

    The answers are pinned before they are used three times, or each use would call the model again.
    """
    answered = pin(generate_json(batches, prompt, model, "answer").select("batch", "answer"))
    is_list = F.col("answer.json").rlike(r"(?s)^\s*\[.*\]\s*$")
    listed = answered.where(is_list).select(
        "batch", F.explode(F.from_json(F.col("answer.json"), T.ArrayType(ANSWER_ROW))).alias("_a")
    )
    matched, unknown = match_back(listed.select("_a.id", "_a.category"), rows)
    failed = answered.where(~F.coalesce(is_list, F.lit(False))).select(
        "batch", F.coalesce("answer.error", F.lit("response was not a JSON list")).alias("error")
    )
    return matched, unknown, failed


def pin(df: DataFrame) -> DataFrame:
    """Keep computed answers in the shared folder; what follows reads them there."""
    from officelake.session import ensure_checkpoints

    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def refine(
    df: DataFrame, prompt: Column, model: ModelSpec, schema: T.StructType, overwrite: list[str]
) -> DataFrame:
    """Overwrite columns with a second, single-row answer; a row whose answer fails stays as it is."""
    full = T.StructType([T.StructField("id", T.StringType())] + schema.fields)
    out = generate_json(df, prompt, model, "_json")
    obj = typed(F.col("_json.json"), full, ["id"])
    good = obj["value"].isNotNull()
    cols = {c: F.when(good, obj["value"][c]).otherwise(F.col(c)) for c in overwrite}
    error = F.coalesce(F.col("_json.error"), obj["error"])
    return out.withColumns({**cols, "refine_error": error}).drop("_json")
