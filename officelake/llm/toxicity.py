"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary text, over shared backoff counts.

Both models predict words by Kneser-Ney counts: in how many different contexts (words before it) a class has a word.
These counts are discounted, with a discount from each class's counts of counts, and what that frees goes to the
counts of both classes together, which are discounted likewise in favour of unseen words. So a word that one class has
in a single context says little, and a word that neither has says next to nothing.

Counts come from every labelled training document but the bounded sample the curve is fitted on. Every seen word has an
entry of its own in a table; only unseen words share one ratio. A table counted to be small is handed to the tasks
whole, a larger one is joined with the distinct words of chunks of texts; both give the same scores. A document's
evidence is its length-normalised log-likelihood ratio, over the whole text and over its strongest passages; a logistic
curve fitted on labelled rows that gave no counts turns it into a probability.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from officelake.llm.common import bounded_sample, known_labels, logistic, pinned, small_side, texts

TOKEN = re.compile(r"\w+")
#: Discount where a class has too few counts to derive one.
DISCOUNT = 0.75
#: Entries up to which tasks are handed the table whole (16 bytes each); beyond, documents are joined with it.
HANDED_ENTRIES = 1 << 22
#: Characters of different texts whose words are looked up together in that join.
CHUNK_CHARS = 4_000_000
#: Words whose ratios a task keeps at hand.
KNOWN_WORDS = 1 << 17
#: Labelled rows the curve is fitted on at most.
CURVE_ROWS = 20_000
#: Rows of either kind a curve needs at least.
FEWEST = 5
WINDOW = 5
#: Ratio of a word that counts as strong, in nats.
STRONG = 2.0
FEATURES = 4
EVIDENCE = "array<double>"
#: Stands before the first word of a text.
START = 0


def words_of(text: str) -> list[str]:
    """Lower-cased words of the whole text."""
    return TOKEN.findall(text.lower())


def key_of(word: str) -> int:
    """64 bits of a word."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def hashed(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Keys of all words; ``known`` keeps those of words met before."""
    for w in set(words):
        if w not in known:
            known[w] = key_of(w)
    return np.array([known[w] for w in words], dtype=np.uint64)


def _contexts(batches):
    """(word, before, classes): the different contexts of a batch's words; bit 0 of classes is ordinary, bit 1 toxic."""
    import pyarrow as pa

    for b in batches:
        known: dict[str, int] = {}
        pairs: list[list[np.ndarray]] = [[], []]
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
            words = hashed(words_of(text), known)
            if len(words):
                pairs[1 if label else 0].append(np.column_stack([words, np.append(np.uint64(START), words[:-1])]))
        for k, found in enumerate(pairs):
            if found:
                every = np.concatenate(found)
                every = every[np.lexsort((every[:, 1], every[:, 0]))]
                every = every[np.append(True, (every[1:] != every[:-1]).any(axis=1))].view(np.int64)
                columns = [pa.array(every[:, 0]), pa.array(every[:, 1]), pa.array(np.full(len(every), k + 1, np.int8))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "before", "classes"])


@dataclass
class Ratios:
    """Log-ratios by word, sorted by key, and what an unseen word has."""

    words: np.ndarray
    ratio: np.ndarray
    unseen: float

    @staticmethod
    def of(key: np.ndarray, ratio: np.ndarray, unseen: float) -> Ratios:
        """From entries in any order."""
        key = key.view(np.uint64)
        order = np.argsort(key, kind="stable")
        return Ratios(key[order], ratio[order], unseen)

    def of_keys(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(wanted), self.unseen)
        at = np.minimum(np.searchsorted(self.words, wanted), len(self.words) - 1)
        return np.where(self.words[at] == wanted, self.ratio[at], self.unseen)

    def ratios(self, words: list[str], known: dict[str, float]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) for each word; ``known`` keeps those of words met before."""
        new = [w for w in set(words) if w not in known]
        known.update(zip(new, self.of_keys(np.array([key_of(w) for w in new], dtype=np.uint64)).tolist()))
        return np.array([known[w] for w in words], dtype=np.float64)

    def evidence(self, text: str, known: dict[str, float]) -> np.ndarray:
        """Mean log-ratio of the text, of its best window, of its best three words, and the share of strong words."""
        words = words_of(text)
        if not words:
            return np.zeros(FEATURES)
        ratio = self.ratios(words, known)
        width = min(WINDOW, len(ratio))
        upto = np.append(0.0, np.cumsum(ratio))
        best = (upto[width:] - upto[:-width]).max() / WINDOW
        top = np.partition(ratio, -3)[-3:] if len(ratio) > 3 else ratio
        return np.array([ratio.mean(), best, np.maximum(top, 0).sum() / 3, (ratio > STRONG).mean()])


@dataclass
class ToxicityModel:
    """Entries (key, ratio) of every seen word, the same as arrays if they are few, and the curve."""

    entries: DataFrame | None
    handed: Ratios | None
    unseen: float
    curve: np.ndarray
    base: float


def fit(docs: DataFrame, labels: DataFrame, held_out=None) -> ToxicityModel:
    """Train on the labelled rows of ``docs`` outside ``held_out`` (a column of doc_id); see the module.

    At most ``CURVE_ROWS`` of every fifth training row (by crc32) are kept for the curve; all others give counts. Without labelled rows of both
    kinds all scores are the share of toxic rows.
    """
    known = known_labels(labels, "toxic")
    if held_out is not None:
        known = known.where(~F.coalesce(held_out, F.lit(False)))
    rest = F.floor(F.crc32(F.col("doc_id").cast("string")) / 4) % 5 == 0
    sides = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    positive, total = sum(n for v, n in sides.items() if v), sum(sides.values())
    base = positive / total if total else 0.0
    none = np.zeros(0)
    nothing = Ratios(none.astype(np.uint64), none, 0.0)
    empty = ToxicityModel(None, nothing, 0.0, np.array([0.0] * FEATURES + [-30.0]), 0.0)
    if not positive or positive == total:
        return empty
    sample = pinned(bounded_sample(known.where(rest), CURVE_ROWS), "toxic-curve")
    counting = known.join(small_side(sample.select("doc_id")), "doc_id", "left_anti")
    rows = texts(docs).join(small_side(counting), "doc_id")
    pairs = rows.select("text", "label").mapInArrow(_contexts, "word long, before long, classes byte")
    counted = pairs.groupBy("word", "before").agg(F.bit_or("classes").alias("classes")).groupBy("word").agg(*_counts())
    model = _smoothed(pinned(counted, "toxic-words"), empty)
    model.base = base
    curve = texts(docs).join(small_side(sample), "doc_id").select("doc_id", "text", "label")
    seen = _evidence(curve, model).select("doc_id", "label", "evidence").toPandas().sort_values("doc_id")
    x, y = np.array(seen["evidence"].tolist(), dtype=np.float64).reshape(-1, FEATURES), seen["label"].to_numpy(dtype=np.float64)
    if FEWEST <= y.sum() <= len(y) - FEWEST:
        model.curve = _rising(x, y)
    if not (model.curve[:-1] > 0).any():  # too few rows for a curve: two nats a word in a window are as good as certain
        model.curve = np.array([0.0, 5.0, 0.0, 0.0, -8.0])
    return model


def _rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve in which no evidence counts against a text that has more of it: such columns are left out."""
    used = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, used], y, ridge=0.3)
        if (w[:-1] >= 0).all() or not used:
            break
        used.pop(int(w[:-1].argmin()))
    full = np.zeros(x.shape[1] + 1)
    full[used], full[-1] = w[:-1], w[-1]
    return full


def _counts() -> list:
    """Contexts of a word in ordinary, toxic and all texts."""
    has = lambda bit: F.count(F.when(F.col("classes").bitwiseAND(bit) > 0, 1))
    return [has(1).alias("t0"), has(2).alias("t1"), F.count(F.lit(1)).alias("t")]


def _smoothed(words: DataFrame, empty: ToxicityModel) -> ToxicityModel:
    """Kneser-Ney with absolute discounts from (word, t0, t1, t): a class's contexts, then those of both, then unseen words."""
    levels = ("t0", "t1", "t")
    total = words.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in levels],
        *[F.count(F.when(F.col(c) > 0, 1)).alias(f"kinds_{c}") for c in levels],
        *[F.count(F.when(F.col(c) == n, 1)).alias(f"{c}_{n}") for c in levels for n in (1, 2)],
    ).first()
    if not total["t"]:
        return empty

    def level(c: str) -> tuple[float, float, float]:
        """Discount, sum of the counts, and the share the discount frees."""
        once, twice = total[f"{c}_1"], total[f"{c}_2"]
        discount = once / (once + 2 * twice) if once and twice else DISCOUNT
        mass = max(1, total[c])
        return discount, mass, discount * total[f"kinds_{c}"] / mass if total[c] else 1.0

    discount, mass, free = level("t")
    unseen_share = free / (total["kinds_t"] + 1)
    shared = (F.col("t") - F.lit(discount)) / mass + F.lit(unseen_share)
    frees, logs = [], []
    for c in levels[:2]:
        d, m, f = level(c)
        frees.append(f)
        logs.append(F.log(F.greatest(F.col(c) - F.lit(d), F.lit(0.0)) / m + F.lit(f) * shared))
    unseen = float(np.log(frees[1] / frees[0]))
    entries = pinned(words.select(F.col("word").alias("key"), (logs[1] - logs[0]).alias("ratio")), "toxic-entries")
    handed = None
    if entries.limit(HANDED_ENTRIES + 1).count() <= HANDED_ENTRIES:
        t = entries.toArrow()
        handed = Ratios.of(t.column("key").to_numpy(), t.column("ratio").to_numpy(), unseen)
    return ToxicityModel(entries, handed, unseen, empty.curve, 0.0)


def _evidence(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """``rows`` with their evidence in place of their column ``text``; without one it is the text within ``row``."""
    import pyarrow as pa
    from pyspark.sql import types as T

    kept = [n for n in rows.columns if n != "text"]
    if model.handed is None:
        text = F.coalesce(F.col("text" if "text" in rows.columns else "row.text"), F.lit(""))
        of_text = [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("b"), text).alias("text_b")]
        found = _joined(rows.select(*of_text, text.alias("text")), model)
        return rows.select(*kept, *of_text).join(found, ["text_a", "text_b"]).select(*kept, "evidence")
    handed = rows.sparkSession.sparkContext.broadcast(model.handed)

    def run(batches):
        for b in batches:
            known: dict[str, float] = {}
            found = []
            for t in b.column("text") if "text" in b.schema.names else b.column("row").field("text"):
                if len(known) > KNOWN_WORDS:
                    known.clear()
                found.append(handed.value.evidence(t.as_py() or "", known).tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(found, pa.list_(pa.float64()))], [*kept, "evidence"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[n] for n in kept), T.StructField("evidence", T.ArrayType(T.DoubleType()))]))


def _joined(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """(text_a, text_b, evidence) of every different text, by joining the words of chunks with the entries.

    A chunk asks for each of its words once, so that a word all texts have is asked for once per chunk.
    """
    import pyarrow as pa

    texts_ = pinned(rows.groupBy("text_a", "text_b").agg(F.first("text").alias("text")), "toxic-texts")
    chars = texts_.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    dealt = texts_.withColumn("chunk", F.pmod("text_a", F.lit(chars // CHUNK_CHARS + 1)))

    def asked(ours: pa.Table) -> pa.Table:
        words = {w for t in ours.column("text").to_pylist() for w in words_of(t)}
        keys = np.array(sorted({key_of(w) for w in words}), dtype=np.uint64)
        return pa.table({"chunk": pa.array(np.full(len(keys), ours.column("chunk")[0].as_py(), np.int64)), "key": pa.array(keys.view(np.int64))})

    keys = dealt.select("chunk", "text").groupBy("chunk").applyInArrow(asked, "chunk long, key long")
    found = keys.join(model.entries, "key").select("chunk", "key", "ratio")
    unseen = model.unseen

    def rated(ours: pa.Table, entries: pa.Table) -> pa.Table:
        ratios = Ratios.of(*(entries.column(c).to_numpy() for c in ("key", "ratio")), unseen)
        known: dict[str, float] = {}
        out = [ratios.evidence(t, known).tolist() for t in ours.column("text").to_pylist()]
        return pa.table({"text_a": ours.column("text_a"), "text_b": ours.column("text_b"), "evidence": pa.array(out, pa.list_(pa.float64()))})

    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(rated, f"text_a long, text_b long, evidence {EVIDENCE}")


def scores(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """``rows`` with ``score``, the probability of being toxic, in place of their column ``text``."""
    found = _evidence(rows, model)
    z = F.lit(float(model.curve[-1]))
    for k, w in enumerate(model.curve[:-1]):
        z = z + F.get("evidence", F.lit(k)) * float(w)
    curve = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    nothing = F.forall("evidence", lambda x: x == 0)
    return found.withColumn("score", F.when(nothing, F.lit(min(model.base, 0.05))).otherwise(curve)).drop("evidence")


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(row, score): every row of ``docs`` as a struct, with its probability of being toxic.

    Null and empty texts and texts without words get a low fixed score; repeated rows score alike; texts of any length
    are scored whole; columns of ``docs`` keep their names inside ``row``.
    """
    return scores(docs.select(F.struct("*").alias("row")), model)


def without_toxic(docs: DataFrame, model: ToxicityModel, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, all columns as they are."""
    return score(docs, model).where(F.col("score") < cut).select("row.*")
