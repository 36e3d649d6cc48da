"""Secret scans: fixed patterns, and two character Markov models (random strings, ordinary identifiers) compared by
log-likelihood ratio, with a threshold calibrated on the ordinary samples. DataFrame functions only; the models are
counted by Spark and handed on as one small literal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from officelake.llm.common import pinned

#: Fixed values of the base patterns, in the order in which kinds rank.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")
#: Characters the Markov models know.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A candidate is a whole run of at least 16 of these characters; those no base match touches train the ordinary model.
RUN = r"[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{RUN})(?={RUN}{{16}}){RUN}++"
#: Least mean log-likelihood ratio per character pair from which a candidate may be a secret.
LEAST_RATIO = 0.5
#: Width of the bins in which the calibrated ratio is looked up.
BIN = 0.01
#: Numbers of an array that are folded at once, and characters of a piece of text that is looked into.
BLOCK, PIECE = 512, 4096


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def before(values: Column, op) -> Column:
    """For each number of an array, ``op`` over those in front of it, beginning with 0.

    Folding with a growing list copies the list at each step, so blocks are folded and then what they come to: the
    work is the array's size times ``BLOCK``.
    """

    def folded(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: folded(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))

    def offset(bs: Column) -> Column:
        return let(
            folded(F.transform(bs, lambda b: b["at"]))["out"],
            lambda offsets: F.flatten(F.zip_with(bs, offsets, lambda b, o: F.transform(b["out"], lambda x: op(o, x)))),
        )

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), offset)).otherwise(F.array().cast("array<int>")))


def plus(a: Column, b: Column) -> Column:
    return a + b


def spans(text: Column, found: Column, pattern: str) -> Column:
    """array<struct(start, end, value)> of the matches, in code points: pieces between matches tell where they are."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("width"), m.alias("value")))

    def placed(steps: Column) -> Column:
        at = before(F.transform(steps, lambda s: s["gap"] + s["width"]), plus)
        return F.zip_with(at, steps, lambda a, s: F.struct((a + s["gap"]).alias("start"), (a + s["gap"] + s["width"]).alias("end"), s["value"].alias("value")))

    return F.when(F.size(found) > 0, let(steps, placed)).otherwise(empty)


def clear_of(own: Column, base: Column) -> Column:
    """The spans of ``own`` (sorted, apart from each other) that overlap no span of ``base``.

    Both are sorted together; the largest end among the base spans in front and the smallest start among those
    behind decide, and both are running extremes.
    """
    far = 2**31 - 1
    tagged = F.array_sort(
        F.concat(
            F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["end"].alias("end"), F.lit("").alias("value"))),
            F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["end"].alias("end"), s["value"].alias("value"))),
        )
    )

    def judged(every: Column) -> Column:
        reached = before(F.transform(every, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(0)), F.greatest)
        # from behind, as distances from the far end, so that 0 begins again
        ahead = F.reverse(before(F.reverse(F.transform(every, lambda s: F.when(s["own"] == 0, far - s["start"]).otherwise(0))), F.greatest))
        limits = F.zip_with(reached, ahead, lambda r, n: F.struct(r.alias("reached"), (far - n).alias("next")))
        flagged = F.zip_with(every, limits, lambda s, x: F.when((s["own"] == 1) & (x["reached"] <= s["start"]) & (x["next"] >= s["end"]), s))
        return F.transform(F.array_compact(flagged), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.when(F.size(base) > 0, let(tagged, judged)).otherwise(own)


def where_found(text: Column, pattern: str, gate: str | None = None, group: int = 0) -> Column:
    """All matches where ``gate`` (a cheaper pattern, the first match at most) matches, else none."""
    none = F.array().cast("array<string>")
    gate = pattern if gate is None else gate
    return F.when(text.rlike(gate), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)


def texts_of(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text (null: empty) of each row, and with ``row`` in ``keep`` the whole row as a struct."""
    row = [F.struct("*").alias("row")] if "row" in keep else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *row)


def with_base(rows: DataFrame) -> DataFrame:
    """``rows`` of texts_of with ``base``: array<struct(start, rank, end, value)> of the base patterns, in reporting
    order, and ``g0``, the values behind all assignments.
    """
    gate = r"(?i)password|passwd|secret|token|api_?key"
    kept = rows.columns
    rows = rows.select(
        "*",
        where_found(F.col("text"), ASSIGN, gate).alias("m0"),
        where_found(F.col("text"), ASSIGN, gate, 2).alias("g0"),
        where_found(F.col("text"), ACCESS).alias("m1"),
        where_found(F.col("text"), HEX).alias("m2"),
    )
    ranked = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end"), s["value"].alias("value"))
    assign = F.zip_with(spans(F.col("text"), F.col("m0"), ASSIGN), "g0", lambda s, g: F.struct(s.alias("s"), g.alias("g")))
    assign = F.transform(F.filter(assign, lambda x: F.length(x["g"]) >= 6), lambda x: x["s"])
    return rows.select(
        *kept,
        "g0",
        F.array_sort(
            F.concat(
                F.transform(assign, ranked(0)),
                F.transform(spans(F.col("text"), F.col("m1"), ACCESS), ranked(1)),
                F.transform(spans(F.col("text"), F.col("m2"), HEX), ranked(2)),
            )
        ).alias("base"),
    )


@dataclass
class SecretModel:
    """log P(random) - log P(ordinary) of each character pair, row by row of ``ALPHABET``, and the ratio a secret has at least."""

    pairs: list[float]
    least: float


def fit(docs: DataFrame, smoothing: float = 0.5) -> SecretModel:
    """Both Markov models and the ratio that tells them apart, from labelled samples of the texts, all of them.

    Values that a base pattern found are random strings, candidates that touch no base match are ordinary. Counts are
    one aggregate with at most two rows per character pair. The ratio is the one, ``LEAST_RATIO`` at least, at which the
    share of random samples that reach it exceeds the share of ordinary ones by most, looked up in a histogram.
    """
    rows = with_base(texts_of(docs)).withColumn("runs", where_found(F.col("text"), CANDIDATE))
    values = F.concat(
        F.filter("g0", lambda g: F.length(g) >= 6),
        F.transform(F.filter("base", lambda s: s["rank"] > 0), lambda s: s["value"]),
    )
    apart = F.transform(clear_of(spans(F.col("text"), F.col("runs"), CANDIDATE), F.col("base")), lambda s: s["value"])
    ordinary = F.when((F.size("base") > 0) & (F.size("runs") > 0), apart).otherwise(F.col("runs"))
    sides = (F.transform(column, lambda v: F.struct(F.lit(side).alias("random"), v.alias("value"))) for side, column in ((1, values), (0, ordinary)))
    samples = pinned(rows.select(F.explode(F.concat(*sides)).alias("s")).select("s.random", "s.value").where("length(value) > 1"), "secret-samples")
    counted = samples.select("random", F.explode(pairs_of(F.col("value"))).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))
    seen = {(r["random"], r["pair"]): r["n"] for r in counted.where(F.col("pair").rlike(f"^{RUN}{{2}}$")).collect()}
    pairs = []
    for a in ALPHABET:
        logs = []
        for side in (1, 0):
            row = [seen.get((side, a + b), 0) + smoothing for b in ALPHABET]
            total = sum(row)
            logs.append([math.log(x / total) for x in row])
        pairs += [p - q for p, q in zip(*logs)]
    assert len(pairs) == len(ALPHABET) ** 2
    lowest = round(LEAST_RATIO / BIN)
    bins = F.greatest(F.floor(ratio(F.col("value"), literal(pairs)) / BIN + 1e-9), F.lit(lowest - 1))
    counts = samples.groupBy("random", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    totals = {k: sum(r["n"] for r in counts if r["random"] == k) or 1 for k in (0, 1)}
    lead, best, least = 0.0, 0.0, lowest
    for at in sorted({r["bin"] for r in counts if r["bin"] >= lowest}, reverse=True):
        lead += sum((1 if r["random"] else -1) * r["n"] / totals[r["random"]] for r in counts if r["bin"] == at)
        if lead >= best:
            best, least = lead, at
    return SecretModel(pairs, least * BIN)


def literal(pairs: list[float]) -> Column:
    """The pairs' ratios as one array."""
    return F.split(F.lit(",".join(f"{x:.3f}" for x in pairs)), ",").cast("array<double>")


def pairs_of(value: Column) -> Column:
    """All pairs of neighbouring characters; the value is taken apart once."""
    return let(F.split(value, ""), lambda c: F.zip_with(F.slice(c, F.lit(1), F.length(value) - 1), F.slice(c, F.lit(2), F.length(value) - 1), lambda a, b: F.concat(a, b)))


def ratio(value: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of the character pairs of a value of two characters or more."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    size = F.length(value) - 1
    gains = lambda c: F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, F.lit(2), size), lambda a, b: F.coalesce(F.get(table, a * len(ALPHABET) + b), F.lit(0.0)))
    return F.aggregate(let(codes, gains), F.lit(0.0), plus) / size


def scan(docs: DataFrame, model: SecretModel, *keep: str) -> DataFrame:
    """(doc_id, base, spans): per row the base matches and all matches, each struct(start, rank, end, value).

    ``rank`` indexes ``KINDS``; starts and ends are code points. A candidate that overlaps no base match and whose mean
    ratio reaches the model's is a match of kind ``random``. Null and empty texts have none; repeated rows are scanned
    alike; the work grows with a text's length and matches, however long a run is. With "row" in ``keep`` the whole
    row comes along as a struct.
    """
    table = literal(model.pairs)
    rows = with_base(texts_of(docs, *keep)).withColumn("m3", where_found(F.col("text"), CANDIDATE))
    likely = F.transform("m3", lambda v: ratio(v, table) >= model.least)
    rows = rows.withColumn("likely", likely)
    own = F.zip_with(spans(F.col("text"), F.col("m3"), CANDIDATE), "likely", lambda s, y: F.when(y, s))
    own = clear_of(F.array_compact(own), F.col("base"))
    own = F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))
    every = F.when(F.array_contains("likely", True), F.array_sort(F.concat("base", own))).otherwise(F.col("base"))
    return rows.select("doc_id", "base", every.alias("spans"), *keep)


def joined(found: Column) -> Column:
    """Matches as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, model: SecretModel, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every match in ``text`` replaced by ``mask`` (overlapping matches by one), n_chars kept right.

    Rows without a match stay as they are, null texts too.
    """
    found = scan(docs, model, "row")
    text = F.col("row.text")

    def kept(blocks: Column) -> Column:
        """What lies between the matches, from the blocks of the text that hold it."""

        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            held = F.slice(blocks, first + 1, F.floor(b / PIECE).cast("int") - first + 1)
            return F.substring(F.array_join(held, ""), a - first * PIECE + 1, b - a)

        gaps = F.zip_with(before(F.transform("spans", lambda s: s["end"]), F.greatest), "spans", lambda a, s: F.when(s["start"] >= a, F.struct(a.alias("a"), s["start"].alias("b"))))
        last = F.struct(F.array_max(F.transform("spans", lambda s: s["end"])).alias("a"), F.length(text).alias("b"))
        return F.array_join(F.transform(F.concat(F.array_compact(gaps), F.array(last)), lambda g: piece(g["a"], g["b"])), mask)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    clean = F.when(F.size("spans") > 0, let(blocks, kept)).otherwise(text)
    out = found.select("row", clean.alias("clean"))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("clean").eqNullSafe(text), F.col("row.n_chars")).otherwise(F.length("clean").cast(kind))
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
