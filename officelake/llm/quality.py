"""Quality rules (isolation forest over rule statistics) and the quality classifier (positive-unlabelled learning).

Both read the same statistics of a text, computed once per document and pinned. The forest draws from all labelled rows
and its threshold comes from counts of all of them; the classifier is fitted on bounded samples, whose bounds are the
constants below.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from officelake.llm.common import WORD, bounded_sample, known_labels, pinned, small_side, texts

#: Labelled rows the classifier is fitted on at most.
SAMPLE_ROWS = 20_000
#: Trees of the forest, and rows that each draws from all labelled ones.
TREES, DRAWN = 200, 64
#: Anomalies of labelled rows are counted in so many steps from 0 to 1 for the threshold.
STEPS = 1 << 16
SYMBOLS = re.compile(r"[#*$%&|<>]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")
END = re.compile(r"[.!?]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shape of a text, all ratios, so that long and short texts compare.
SHAPE = (
    "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "end_share",
    "distinct_share", "top_word_share", "same_pair_share", "exclaim_share", "pack_ratio", "worst_upper", "worst_symbol",
    "worst_distinct", "log_words", "word_length_spread", "line_words",
)
#: What the forest splits on: all rule statistics but the one that only tells short texts from long ones.
RULES = [i for i, n in enumerate(SHAPE) if n != "log_words"]
#: Passages over which the worst upper-case, symbol and distinct-word shares are taken.
PASSAGE = 40


def repeated(words: list[str], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more, its first place included."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    hit = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=len(windows))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:-size][hit] += 1
    edge[size:][hit] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts of ``BASE`` and the ratios of ``SHAPE`` of a whole text; zeros for a text without words."""
    words = WORD.findall(text)
    n = len(words)
    symbols = len(SYMBOLS.findall(text))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    if not n:
        return [0, 0, symbols, 0, 0], [0.0] * len(SHAPE)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    chars = int(lengths.sum())
    again = repeated(words)
    upper = len(UPPER.findall(text))
    seen = Counter(words)
    steps = range(0, n, PASSAGE)
    worst = [0.0, 0.0, 1.0]
    for i in steps:
        part = words[max(0, min(i, n - PASSAGE)) : max(0, min(i, n - PASSAGE)) + PASSAGE]
        joined = "".join(part)
        worst[0] = max(worst[0], len(UPPER.findall(joined)) / max(len(joined), 4 * PASSAGE))
        worst[1] = max(worst[1], len(SYMBOLS.findall(joined)) / max(len(part), PASSAGE))
        worst[2] = min(worst[2], len(set(part)) / len(part))
    raw = text.encode("utf-8", "replace")
    packed = len(zlib.compress(raw, 1)) / (len(raw) + 60)
    shape = [
        chars / n,
        symbols / (n + PASSAGE),
        dup / max(1, len(lines)),
        again / n,
        upper / (chars + 60),
        len(DIGIT.findall(text)) / chars,
        len(END.findall(text)) / n,
        len(seen) / n**0.9,
        max(seen.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / (n + PASSAGE),
        text.count("!") / (n + PASSAGE),
        packed,
        *worst,
        float(np.log1p(n)),
        float(lengths.std()),
        float(np.log1p(n / max(1, len(lines)))),
    ]
    return [n, chars, symbols, dup, again], shape


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, the columns of BASE, shape) of every row, computed once and pinned in the shared folder.

    A null text counts as empty, and a text without words has zeros but for its symbols; texts of any length are
    measured whole; repeated rows and rows without an id are measured each; other columns aren't read.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            found = [statistics(t) for t in b.column("text").to_pylist()]
            base = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *base, pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["doc_id", *BASE, "shape"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", shape array<double>"
    return pinned(texts(docs).mapInArrow(run, schema), "text-shapes")


def _sampled(stats: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and labels of a bounded, hash-chosen sample of the labelled rows, in a fixed order."""
    sample = small_side(bounded_sample(known, SAMPLE_ROWS))
    rows = stats.where("n_words > 0").select("doc_id", "shape").join(sample, "doc_id").toPandas()
    rows = rows.sort_values(["doc_id"], kind="stable")
    return np.array(rows["shape"].tolist(), dtype=np.float64).reshape(-1, len(SHAPE)), rows["label"].to_numpy(dtype=np.int64)


# --- isolation forest -------------------------------------------------------------------------------------------


def mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points: what a leaf of n points still has to go."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe, np.where(n > 1, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as flat arrays: split column (-1: leaf), split value, left child, path length at a leaf."""

    column: np.ndarray
    value: np.ndarray
    child: np.ndarray
    length: np.ndarray
    size: int
    threshold: float = 1.0

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path length / expected length): near 1 for points that few random splits set apart."""
        x = x[:, RULES]
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.column)):
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                c = self.column[t][at]
                inner = c >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(c, 0)] >= self.value[t][at]
                at = np.where(inner, self.child[t][at] + right, at)
            total += self.length[t][at]
        return 2.0 ** (-total / len(self.column) / max(1e-9, float(mean_depth(self.size))))


def grow_forest(x: np.ndarray, trees: int = 200, size: int = 64, seed: int = 7) -> IsolationForest:
    """Random splits of ``size`` sampled rows per tree, down to single points or log2(size) + 4 levels."""
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    return _grown([lambda: x[rng.choice(len(x), size, replace=False)]] * trees, size, rng)


def forest_of(drawn: list[np.ndarray], seed: int = 7) -> IsolationForest:
    """The same of rows that have been drawn, a tree for each part."""
    return _grown([lambda part=part: part for part in drawn], max(len(part) for part in drawn), np.random.default_rng(seed))


def _grown(draws: list, size: int, rng: np.random.Generator) -> IsolationForest:
    deepest = int(np.ceil(np.log2(max(2, size)))) + 4
    forest = []
    for draw in draws:
        column, value, child, length = [], [], [], []
        todo = [(0, draw(), 0)]
        for a in (column, value, child, length):
            a.append(0)
        while todo:
            at, part, depth = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if len(part) < 2 or not len(wide) or depth >= deepest:
                column[at], length[at] = -1, depth + float(mean_depth(len(part)))
                continue
            c = int(rng.choice(wide))
            v = float(rng.uniform(low[c], high[c]))
            if not low[c] < v:
                v = float(high[c])
            column[at], value[at], child[at] = c, v, len(column)
            for side, go in ((part[part[:, c] < v], 0), (part[part[:, c] >= v], 1)):
                for a in (column, value, child, length):
                    a.append(0)
                todo.append((child[at] + go, side, depth + 1))
        forest.append((column, value, child, length))
    most = max(len(f[0]) for f in forest)
    pad = lambda i, kind: np.array([list(f[i]) + [0 if i else -1] * (most - len(f[i])) for f in forest], dtype=kind)
    return IsolationForest(pad(0, np.int64), pad(1, np.float64), pad(2, np.int64), pad(3, np.float64), size)


def best_threshold(score: np.ndarray, good: np.ndarray, keep: float) -> float:
    """The threshold above which a score is anomalous: best balanced accuracy among those that keep most good rows."""
    order = np.argsort(score)
    s, g = score[order], good[order]
    kept_good = np.cumsum(g) / max(1, g.sum())
    dropped_bad = 1 - np.cumsum(~g) / max(1, (~g).sum())
    value = np.where(kept_good >= keep, kept_good + dropped_bad, kept_good - 1)
    at = len(value) - 1 - int(np.argmax(value[::-1]))
    return float(s[at] + 1e-12) if at + 1 >= len(s) else float((s[at] + s[at + 1]) / 2)


def base_failed(least_words: int = 10, most_repeated: int = 20) -> Column:
    """Rows the plain rules reject: too few words, or too large a part of them in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def _drawn(candidates: DataFrame, trees: int, size: int) -> list[np.ndarray]:
    """For each tree the shapes of ``size`` rows drawn from all of ``candidates``: those whose ids hash lowest for it."""
    total = candidates.count()
    place = F.pmod(F.xxhash64(F.lit("tree"), F.col("tree"), F.col("doc_id")), F.lit(1 << 40))
    dealt = candidates.select("doc_id").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("place", place)
    if total > 8 * size:  # thinned first, to far more rows than are drawn
        dealt = dealt.where(F.col("place") < int((1 << 40) * min(1.0, 4 * size / total)))
    least = Window.partitionBy("tree").orderBy("place", "doc_id")
    chosen = dealt.withColumn("at", F.row_number().over(least)).where(F.col("at") <= size).select("tree", "at", "doc_id")
    shapes = candidates.groupBy("doc_id").agg(F.min("shape").alias("shape"))
    rows = shapes.join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["tree", "at"], kind="stable")
    return [np.array(part["shape"].tolist(), dtype=np.float64).reshape(-1, len(SHAPE)) for _, part in rows.groupby("tree", sort=True)]


def _counted(candidates: DataFrame, forest: IsolationForest) -> pd.DataFrame:
    """(step, n, good, least, most): all ``candidates`` counted by steps of anomaly, each 1 / ``STEPS`` wide."""
    handed = candidates.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def anomaly(shape: pd.Series) -> pd.Series:
        return pd.Series(handed.value.anomaly(np.array(shape.tolist(), dtype=np.float64).reshape(-1, len(SHAPE))))

    scored = candidates.select(anomaly("shape").alias("score"), "label").withColumn("step", F.floor(F.col("score") * STEPS))
    counts = scored.groupBy("step").agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0).alias("good"), F.min("score").alias("least"), F.max("score").alias("most"))
    return counts.toPandas().sort_values("step", kind="stable")


def counted_threshold(counts: pd.DataFrame, keep: float) -> float:
    """``best_threshold`` of counted scores, between two steps."""
    good, bad = counts["good"].to_numpy(np.float64), (counts["n"] - counts["good"]).to_numpy(np.float64)
    least, most = counts["least"].to_numpy(), counts["most"].to_numpy()
    if not bad.sum():
        return float(most[-1])
    kept_good, dropped_bad = np.cumsum(good) / max(1.0, good.sum()), 1 - np.cumsum(bad) / bad.sum()
    value = np.where(kept_good >= keep, kept_good + dropped_bad, kept_good - 1)
    at = len(value) - 1 - int(np.argmax(value[::-1]))
    return float(most[at] + 1e-12 if at + 1 >= len(value) else (most[at] + least[at + 1]) / 2)


def fit_forest(stats: DataFrame, labels: DataFrame, keep: float = 0.99) -> IsolationForest | None:
    """A forest over labelled rows of ``stats`` that the base rules pass; None without any (then they decide alone).

    Each tree draws its rows, as the method has it few of them so that bad rows of one kind don't hide each other,
    from all labelled rows, and never sees the labels. The threshold is the one that tells bad rows from good ones best
    while it keeps ``keep`` of the good; all labelled rows are scored and counted for it.
    """
    known = known_labels(labels, "quality")
    candidates = pinned(stats.where(~base_failed() & F.col("doc_id").isNotNull() & (F.col("n_words") > 0)).select("doc_id", "shape").join(known, "doc_id"), "labelled-shapes")
    total, good = candidates.agg(F.count("*"), F.count_if(F.col("label") > 0)).first()
    if total < 8 or not good:
        return None
    forest = forest_of([x[:, RULES] for x in _drawn(candidates, TREES, DRAWN)])
    forest.threshold = counted_threshold(_counted(candidates, forest), keep)
    return forest


def judged(stats: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """``stats`` with base_failed, anomaly and kept: not base_failed and no more anomalous than the threshold.

    A row just at the threshold is kept. Without a forest the base rules decide alone; texts without words fail them.
    """
    failed = base_failed()
    if forest is None:
        return stats.withColumn("base_failed", failed).withColumn("anomaly", F.lit(0.0)).withColumn("kept", ~failed)
    handed = stats.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def anomaly(shape: pd.Series) -> pd.Series:
        return pd.Series(handed.value.anomaly(np.array(shape.tolist(), dtype=np.float64).reshape(-1, len(SHAPE))))

    out = stats.withColumn("base_failed", failed).withColumn("anomaly", anomaly("shape"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= forest.threshold))


# --- positive-unlabelled classifier ------------------------------------------------------------------------------


@dataclass
class PUClassifier:
    """A small network on standardised shapes, trained by non-negative unbiased risk, and its estimated prior."""

    center: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    prior: float
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        h = np.clip((x - self.center) / self.scale, -8, 8)
        for w, b in self.layers[:-1]:
            h = np.maximum(h @ w + b, 0)
        w, b = self.layers[-1]
        return (h @ w + b)[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) + self.shift, -30, 30)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled scores: the smallest ratio of the two distributions' upper parts.

    Bins hold an equal part of the positives; each ratio gets a deviation's allowance, so that small bins don't rule.
    """
    best = 1.0
    for q in np.linspace(0.0, 0.95, 39):
        cut = np.quantile(positive, q)
        p, u = (positive >= cut).mean(), (unlabelled >= cut).mean()
        if p > 0:
            slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled))) / p
            best = min(best, u / p + slack * 0.5)
    return float(np.clip(best, 0.05, 0.98))


def train_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, hidden: int = 24, rounds: int = 900, seed: int = 11) -> PUClassifier:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) by Adam; where the second part turns negative, step back.

    Without a given prior it is estimated from the scores of a first fit that takes unlabelled for negative.
    """
    every = np.vstack([positive, unlabelled])
    center = np.median(every, axis=0)
    scale = np.maximum(every.std(axis=0), 1e-3)
    if prior is None:
        # each half is scored by a fit that hasn't seen it: a fit knows its own positives by heart
        halves = [(positive[k::2], unlabelled[k::2]) for k in (0, 1)]
        fits = [_adam(p, u, center, scale, None, hidden, rounds // 3, seed) for p, u in halves if len(p)]
        unseen = [(f.margin(p), f.margin(u)) for f, (p, u) in zip(fits, halves[::-1]) if len(p)] or [(fits[0].margin(positive), fits[0].margin(unlabelled))]
        prior = float(np.mean([estimated_prior(p, u) for p, u in unseen]))
    return _adam(positive, unlabelled, center, scale, prior, hidden, rounds, seed)


def _adam(positive, unlabelled, center, scale, prior, hidden, rounds, seed) -> PUClassifier:
    rng = np.random.default_rng(seed)
    dims = [positive.shape[1], hidden, 1]
    layers = [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(dims, dims[1:])]
    model = PUClassifier(center, scale, layers, prior if prior is not None else 0.5)
    flat = [a for pair in layers for a in pair]
    m, v = [np.zeros_like(a) for a in flat], [np.zeros_like(a) for a in flat]
    norm = lambda x: np.clip((x - center) / scale, -8, 8)
    p, u = norm(positive), norm(unlabelled)
    batch = 1024
    for step in range(1, rounds + 1):
        pb = p[rng.integers(0, len(p), min(batch, len(p)))]
        ub = u[rng.integers(0, len(u), min(batch, len(u)))]
        x = np.vstack([pb, ub])
        (w1, b1), (w2, b2) = layers
        h = np.maximum(x @ w1 + b1, 0)
        z = np.clip((h @ w2 + b2)[:, 0], -30, 30)
        s = 1 / (1 + np.exp(-z))
        zp, zu, sp, su = z[: len(pb)], z[len(pb) :], s[: len(pb)], s[len(pb) :]
        soft = lambda t: np.logaddexp(0, t)
        if prior is None:
            dp, du = (sp - 1) / len(pb), su / len(ub)
        else:
            negative = soft(zu).mean() - prior * soft(zp).mean()
            if negative >= 0:
                dp, du = prior * (sp - 1) / len(pb) - prior * sp / len(pb), su / len(ub)
            else:
                dp, du = prior * sp / len(pb), -su / len(ub)
        dz = np.concatenate([dp, du])[:, None]
        dh = (dz @ w2.T) * (h > 0)
        grads = [x.T @ dh + 1e-4 * w1, dh.sum(0), h.T @ dz + 1e-4 * w2, dz.sum(0)]
        rate = 0.01 if step < rounds * 0.7 else 0.002
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            flat[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return model


def fit_quality(stats: DataFrame, labels: DataFrame, held_out=None, cut: float = 0.3) -> PUClassifier | None:
    """A classifier from trusted positives and unlabelled rows, both bounded samples outside ``held_out``.

    Positives are rows labelled 1; the unlabelled side is drawn from all rows with words outside ``held_out``,
    whatever their labels say. Rows labelled 0 serve once, after training: they place the curve so that ``cut``
    parts them from the positives best. None without positives.
    """
    known = known_labels(labels, "quality")
    rows = stats.where("n_words > 0")
    if held_out is not None:
        outside = ~F.coalesce(held_out, F.lit(False))
        known, rows = known.where(outside), rows.where(outside)
    x, y = _sampled(stats, known)
    if not (y > 0).any():
        return None
    free = bounded_sample(rows.select("doc_id", "shape"), SAMPLE_ROWS).select("shape").toPandas()
    unlabelled = np.array(free["shape"].tolist(), dtype=np.float64).reshape(-1, len(SHAPE))
    model = train_pu(x[y > 0], unlabelled)
    if (y <= 0).any():
        line = best_threshold(-model.margin(x), y > 0, 0.95)
        model.shift = line + float(np.log(cut / (1 - cut)))
    return model


def quality_scores(stats: DataFrame, model: PUClassifier | None) -> DataFrame:
    """``stats`` with score, the probability of label 1; a text without words gets 0, and so do all without a model.

    Equal texts score alike, whatever their ids and labels.
    """
    if model is None:
        return stats.withColumn("score", F.lit(0.0))
    handed = stats.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(shape: pd.Series) -> pd.Series:
        return pd.Series(handed.value.probability(np.array(shape.tolist(), dtype=np.float64).reshape(-1, len(SHAPE))))

    return stats.withColumn("score", F.when(F.col("n_words") > 0, score("shape")).otherwise(F.lit(0.0)))
