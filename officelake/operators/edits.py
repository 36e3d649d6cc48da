"""Document edits: offsets, order, application. Offsets are UTF-16 code units; a body starts at index 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from officelake.functions.strings import utf16_len
from officelake.operators.ordering import running_total

SLACK = 3  # fixed value: how far outside the document an offset may lie to be corrected
DELETE_FIRST = {"insert": 0, "delete": 1}  # fixed values: at one index a delete comes before an insert


def clamp(edits: DataFrame, end: Column) -> DataFrame:
    """Edits with their offsets moved into the document, and an ``error`` for those far outside.

    ``end`` is the last index of the document. Delete ranges are turned round when they start after their end.
    """
    index, stop = F.col("index"), F.col("end")
    is_delete = F.col("kind") == "delete"
    checked = F.when(is_delete, F.greatest(index, stop)).otherwise(index)
    lowest = F.when(is_delete, F.least(index, stop)).otherwise(index)
    error = F.when(checked > end + SLACK, "far beyond document end").when(lowest < -SLACK, "far before document start")

    def into(c: Column) -> Column:
        return F.greatest(F.least(c, end - 1), F.lit(1).cast("long"))

    first, last = into(index), into(stop)
    return edits.withColumns(
        {
            "index": F.when(is_delete, F.least(first, last)).otherwise(first),
            "end": F.when(is_delete, F.greatest(first, last)),
            "error": error,
        }
    )


def edit_order() -> list[Column]:
    """Order of application: highest index first, deletes before inserts there, then arrival."""
    kind = F.create_map(*[x for k, v in DELETE_FIRST.items() for x in (F.lit(k), F.lit(v))])
    return [F.col("index").desc(), kind[F.col("kind")].desc(), F.col("seq").asc()]


def _splice(text: Column, e: Column) -> Column:
    """UTF-16 bytes with one edit applied; two bytes per unit, so byte offsets are twice the index."""
    at = ((e["index"] - 1) * 2).cast("int")
    upto = F.when(e["kind"] == "delete", ((e["end"] - 1) * 2).cast("int")).otherwise(at)
    inserted = F.when(e["kind"] == "insert", F.encode(e["content"], "UTF-16LE")).otherwise(F.lit(b""))
    return F.concat(F.substring(text, F.lit(1), at), inserted, F.substring(text, upto + 1, F.octet_length(text)))


def _end_of(e: Column) -> Column:
    return F.when(e["kind"] == "delete", e["end"]).otherwise(e["index"])


def _in_one_pass(rising: Column, units: Column) -> Column:
    """Text with edits that do not meet each other, as one concatenation of slices and contents."""

    def piece(e: Column, i: Column) -> Column:
        at = F.when(i == 0, F.lit(1).cast("long")).otherwise(_end_of(F.try_element_at(rising, F.greatest(i, F.lit(1)))))
        before = F.substring(units, ((at - 1) * 2 + 1).cast("int"), ((e["index"] - at) * 2).cast("int"))
        return F.concat(F.decode(before, "UTF-16LE"), F.coalesce(e["content"], F.lit("")))

    tail = F.substring(units, ((_end_of(F.element_at(rising, -1)) - 1) * 2 + 1).cast("int"), F.octet_length(units))
    return F.concat(F.array_join(F.transform(rising, piece), ""), F.decode(tail, "UTF-16LE"))


def _meet(rising: Column, units: Column) -> Column:
    """Whether an edit lies inside a deleted range or outside the text, so that the order of edits matters."""

    def inside(e: Column, i: Column) -> Column:
        return (i > 0) & (_end_of(F.try_element_at(rising, F.greatest(i, F.lit(1)))) > e["index"])

    outside = (F.element_at(rising, -1)["index"] > F.octet_length(units) / 2 + 1) | (rising[0]["index"] < 1)
    return F.exists(F.transform(rising, inside), lambda x: x) | outside


def apply_edits(documents: DataFrame, edits: DataFrame, flag: str | None = None) -> DataFrame:
    """Documents (doc_id, text) with all their edits applied in order, highest index first.

    A document's text is one value, and its edits meet there in one list. Edits that do not meet each other are one
    concatenation; only documents where they do fold them over the text one by one. ``flag`` names a column that says
    whether a document has edits.
    """
    first = F.struct((-F.col("index")).alias("_back"), (F.col("kind") != "delete").alias("_late"), F.col("seq").alias("_seq"))
    item = F.struct(first.alias("_first"), "kind", "index", "end", "content")
    folded = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(item), asc=False).alias("_rising"))
    # The text's units are a column of their own: inside the functions over the edits they would be encoded anew for
    # every edit.
    units = F.when(F.col("_rising").isNotNull(), F.encode("text", "UTF-16LE"))
    both = documents.join(folded, "doc_id", "left").withColumn("_units", units)
    rising, units = F.col("_rising"), F.col("_units")
    one_by_one = F.decode(F.aggregate(F.reverse(rising), units, _splice), "UTF-16LE")
    after = F.when(_meet(rising, units), one_by_one).otherwise(_in_one_pass(rising, units))
    done = both.withColumn("text", F.when(rising.isNotNull(), after).otherwise(F.col("text")))
    return (done.withColumn(flag, rising.isNotNull()) if flag else done).drop("_rising", "_units")


def executed_ids(edits: DataFrame) -> DataFrame:
    """Distinct ids of the items the edits came from."""
    return edits.select("doc_id", F.explode("origin_ids").alias("origin_id")).distinct()


def sequential_inserts(contents: DataFrame, index: Column, forward: bool, bounded: bool = False) -> DataFrame:
    """Insert contents one after the other at an index and report the index each left behind.

    Without ``forward`` the index stays, which leaves the contents in reverse order in the text; with it the
    index moves on by what was inserted.
    """
    if not forward:
        return contents.withColumn("insert_at", index).withColumn("next_index", index)
    size = utf16_len(F.col("content"))
    moved = running_total(contents, ["doc_id"], [F.col("seq")], size, "next_index", bounded)
    return moved.withColumn("next_index", index + F.col("next_index")).withColumn(
        "insert_at", F.col("next_index") - size
    )


def shift_spans(spans: Column, offset: Column) -> Column:
    """Spans moved by an offset in struct<value, error>; an offset below 1 is an error."""
    moved = F.transform(
        spans, lambda s: s.withField("start", s["start"] + offset).withField("end", s["end"] + offset)
    )
    error = F.when(offset <= 0, F.concat(F.lit("Offset cannot be less than 1, was "), offset.cast("string")))
    return F.struct(F.when(error.isNull(), moved).alias("value"), error.alias("error"))


def newline_guard(inserts: DataFrame, elements: DataFrame) -> DataFrame:
    """Put a newline before an insert that is not at the end of a paragraph."""
    ends = elements.select("doc_id", F.col("end_index").alias("index"), F.lit(True).alias("_on")).distinct()
    on = F.col("_on").isNotNull()
    return (
        inserts.join(ends, ["doc_id", "index"], "left")
        .withColumn("prefix", F.when(on, "").otherwise("\n"))
        .withColumn("error", F.when(F.col("index") <= 1, "cannot insert before the start of the document"))
        .withColumn("final_index", F.when(on, F.col("index")).otherwise(F.col("index") + 1))
        .drop("_on")
    )


def item_edits(items: DataFrame, index: Column, content: Column, seq: Column) -> DataFrame:
    """Action items as insert edits that name where they come from."""
    origin = F.concat_ws("|", F.col("analysis_id").cast("string"), F.col("action_number").cast("string"))
    return items.select(
        "doc_id",
        seq.alias("seq"),
        F.lit("insert").alias("kind"),
        index.cast("long").alias("index"),
        F.lit(None).cast("long").alias("end"),
        content.alias("content"),
        F.array(origin).alias("origin_ids"),
    )


def insert_text(text: Column, index: Column, content: Column) -> Column:
    """Text with a content spliced in at an index."""
    edit = F.struct(F.lit("insert").alias("kind"), index.alias("index"), index.alias("end"), content.alias("content"))
    return F.decode(_splice(F.encode(text, "UTF-16LE"), edit), "UTF-16LE")


def delete_range(text: Column, start: Column, end: Column) -> Column:
    """Text without a range."""
    edit = F.struct(F.lit("delete").alias("kind"), start.alias("index"), end.alias("end"), F.lit("").alias("content"))
    return F.decode(_splice(F.encode(text, "UTF-16LE"), edit), "UTF-16LE")


