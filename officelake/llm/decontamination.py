"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows of the templates
are joined by hash, and the values in the placeholders must change consistently. Items too rich in values for a
template are looked for word by word. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from officelake.llm.common import pinned, small_side

#: Tokens in a template window.
WINDOW = 8
#: Literal (not placeholder) tokens a window needs to count.
LITERALS = 4
#: Item windows up to which they are handed to every task.
HANDED_WINDOWS = 200_000
#: Share of an item's windows that must be found in one document.
COVERAGE = 0.5
NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
INNER = "\u0004"
#: Words that count as units behind a number.
UNITS = (
    "kg|g|mg|lb|lbs|oz|tons?|tonnes?|km|cm|mm|m|mi|miles?|ft|feet|foot|inch|inches|yd|yards?|meters?|metres?|kilometers?|kilometres?|"
    "l|ml|liters?|litres?|gallons?|cups?|s|sec|seconds?|min|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|kmh|mph|"
    "dollars?|euros?|cents?|pounds?|percent|degrees?|usd|eur"
)


def marked(text: Column) -> Column:
    """The tokens of a text, lower-cased and without punctuation; values of placeholders keep their marker in front.

    A number is a run of digits that touches no letter, inner separators included; a unit is one of ``UNITS`` right
    behind a number; a name is a capitalised word that doesn't begin a text, line or sentence. Words in capitals
    throughout are no names.
    """
    t = F.coalesce(text, F.lit(""))
    digits = F.regexp_replace(t, r"(?<=\p{N})[.,:/](?=\p{N})", INNER)
    digits = F.regexp_replace(digits, rf"(?<=\p{{N}})\s?((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", rf" {UNIT}$1")
    digits = F.regexp_replace(digits, rf"(?<![\p{{L}}\p{{N}}{INNER}])(\p{{N}}[\p{{N}}{INNER}]*+)(?!\p{{L}})", rf" {NUMBER}$1")
    t = F.when(t.rlike(r"\p{N}"), digits).otherwise(t)
    t = F.regexp_replace(t, r"(?<=[^\s.!?:]\s)(\p{Lu}[\p{Ll}\p{M}]+)(?![\p{L}\p{N}])", rf"{NAME}$1")
    t = F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}{NAME}{UNIT}{INNER}]+", " ")
    return F.split(F.trim(t), " ")


def template(tokens: Column) -> Column:
    """Tokens with every placeholder reduced to its marker."""
    joined = F.array_join(tokens, " ")
    bare = F.regexp_replace(joined, rf"([{NUMBER}{NAME}{UNIT}])[^ ]*", "$1")
    return F.when(joined.rlike(f"[{NUMBER}{NAME}{UNIT}]"), F.split(bare, " ")).otherwise(tokens)


def variants(tokens: Column) -> Column:
    """The templates of a text: names as placeholders and, where there are any, names as words too.

    What begins a sentence in one copy of a text may not in another, and capitals may be lost: with both forms on both
    sides, copies that differ in such things still meet.
    """
    joined = F.array_join(tokens, " ")
    words = F.regexp_replace(F.regexp_replace(joined, NAME, ""), rf"([{NUMBER}{UNIT}])[^ ]*", "$1")
    typed = template(tokens)
    return F.when(F.contains(joined, F.lit(NAME)), F.array(typed, F.split(words, " "))).otherwise(F.array(typed))


def plain_words(tokens: Column) -> Column:
    """Tokens without their markers."""
    return F.split(F.regexp_replace(F.array_join(tokens, " "), f"[{NUMBER}{NAME}{UNIT}]", ""), " ")


def window_hashes(tmpl: Column, size: Column | int) -> Column:
    """A hash of each window of ``size`` template tokens; none for a shorter text."""
    width = F.lit(size) if isinstance(size, int) else size
    last = F.size(tmpl) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(tmpl, i, width)))).otherwise(F.array().cast("array<bigint>"))


def _forms(rows: DataFrame, word_by_word: bool) -> DataFrame:
    """``rows`` (with ``raw``) once for each form of their texts: ``tmpl``, and ``typed``, the values of its placeholders in their places.

    The word-by-word form has no placeholders.
    """
    forms = variants(F.col("raw"))
    if word_by_word:
        forms = F.array(plain_words(F.col("raw")))
    rows = rows.withColumn("tmpl", F.explode(forms))
    # names count as words where the template has them as words
    return rows.withColumn("typed", F.zip_with("raw", "tmpl", lambda r, t: F.when(t < INNER, r)))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, item_pos, width, word_by_word, window, own, n_windows): the windows by which each item is found.

    These are its template windows with enough literals: ``LITERALS``, or all of them in an item of fewer than ``WINDOW``
    tokens, which is one window. An item that has no such window is found by its own words and values instead, all
    windows of them.
    """
    rows = items.select("item_id", marked(F.col("text")).alias("raw")).where("raw[0] <> ''")
    rows = pinned(rows, "benchmark-tokens")

    def windows(rows: DataFrame, word_by_word: bool) -> DataFrame:
        rows = _forms(rows, word_by_word).withColumn("width", F.least(F.size("tmpl"), F.lit(WINDOW)))
        rows = rows.select("item_id", "tmpl", "typed", "width", F.posexplode(window_hashes(F.col("tmpl"), F.col("width"))).alias("at", "window"))
        of = lambda c: F.slice(c, F.col("at") + 1, F.col("width"))
        return rows.select(
            "item_id",
            (F.col("at") + 1).alias("item_pos"),
            "width",
            F.lit(word_by_word).alias("word_by_word"),
            "window",
            F.array_compact(of("typed")).alias("own"),
            F.size(F.filter(of("tmpl"), lambda t: t > INNER)).alias("literals"),
        ).dropDuplicates(["item_id", "item_pos", "window", "own"])

    typed = windows(rows, False).where(f"literals >= least({LITERALS}, width)")
    other = windows(rows.join(typed.select("item_id"), "item_id", "left_anti"), True)
    every = pinned(typed.unionByName(other).drop("literals"), "benchmark-windows")
    counts = every.groupBy("item_id").agg(F.count_distinct("item_pos").alias("n_windows"))
    return every.join(counts, "item_id")


def _consistent(windows: Column, slots: Column) -> Column:
    """The windows whose values can be those of the same question with other values.

    In a window, equal values of the item must have become equal values. Different ones may have become equal by a new
    draw, but if what they became is itself a value of the item, roles were mixed up: windows with such a slot don't count.
    """
    mixed_up = F.filter(
        slots,
        lambda p: F.exists(slots, lambda q: (q["own"] == p["own"]) & (q["theirs"] != p["theirs"])) & F.exists(slots, lambda q: q["theirs"] == p["own"]),
    )
    agree = lambda w: ~F.exists(w["slots"], lambda p: F.exists(w["slots"], lambda q: (q["theirs"] == p["theirs"]) & (q["own"] != p["own"])))
    return F.filter(windows, lambda w: agree(w) & ~F.arrays_overlap(w["slots"], mixed_up))


def matches(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, exact): documents that hold an item, word for word or re-parameterised.

    A document holds an item if, at places where one alignment puts them, windows of the item's template stand in
    its own template with consistent values, and these windows make up ``coverage`` of the item. ``exact``: all
    their values are the item's own. Null and empty texts hold nothing and are held by nothing; equal items are all
    reported, texts of items with one id are one item; repeated rows of a document, and rows of one id, count as one
    document; rows with a null id are left out.

    The item windows are broadcast if counted to be few, else joined by a shuffle on the window. In that join a
    document's rows have a window's hash and the few values in it, never the text; either way each text is read once
    for each form and width of windows.
    """
    theirs = pinned(item_windows(items.where("item_id IS NOT NULL")), "benchmark-index")
    kinds = sorted((r["word_by_word"], r["width"]) for r in theirs.select("word_by_word", "width").distinct().collect())  # at most 2 * WINDOW
    few = theirs.limit(HANDED_WINDOWS + 1).count() <= HANDED_WINDOWS
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), marked(F.col("text")).alias("raw"))
    every = None
    for word_by_word, width in kinds or [(False, WINDOW)]:
        of = _forms(rows, word_by_word)
        known = theirs.where((F.col("width") == width) & (F.col("word_by_word") == word_by_word))
        values = lambda at: F.array_compact(F.slice("typed", at + 1, F.lit(width)))
        hashes = window_hashes(F.col("tmpl"), width)
        if few:
            own = of.select("doc_id", "typed", F.posexplode(hashes).alias("at", "window")).join(F.broadcast(known), "window")
            own = own.withColumn("here", values(F.col("at")))
        else:
            placed = F.transform(hashes, lambda h, at: F.struct(at.alias("at"), h.alias("window"), values(at).alias("here")))
            own = of.select("doc_id", F.explode(placed).alias("w")).select("doc_id", "w.*").join(known, "window")
        found = own.select(
            "doc_id",
            "item_id",
            "n_windows",
            (F.col("at") + 1 - F.col("item_pos")).alias("shift"),
            F.struct(
                "item_pos", F.zip_with("own", "here", lambda i, d: F.struct(i.alias("theirs"), d.alias("own"))).alias("slots")
            ).alias("found"),
        )
        every = found if every is None else every.unionByName(found)
    aligned = every.groupBy("doc_id", "item_id", "n_windows", "shift").agg(F.collect_set("found").alias("windows"))
    aligned = aligned.withColumn("slots", F.array_distinct(F.flatten(F.col("windows.slots"))))
    aligned = aligned.withColumn("windows", _consistent(F.col("windows"), F.col("slots")))
    exact = ~F.exists("windows", lambda w: F.exists(w["slots"], lambda p: p["theirs"] != p["own"]))
    whole = (
        aligned.where(F.size("windows") > 0)
        .withColumn("exact", exact)
        .groupBy("doc_id", "item_id", "n_windows")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set("windows.item_pos")))).alias("found"), F.min("exact").alias("exact"))
    )
    share = F.col("found") / F.col("n_windows")
    return whole.where(share >= coverage).select(
        "doc_id", "item_id", F.col("found").cast("long").alias("n_windows"), share.alias("coverage"), "exact"
    )


def without_matches(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are (rows with a null id stay)."""
    # pinned: counting it before the join would look for matches twice
    held = pinned(matches(docs, items, coverage).select("doc_id").distinct(), "held")
    nested = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return nested.join(small_side(held), "doc_id", "left_anti").select("row.*")
