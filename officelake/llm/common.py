"""What the operators of this subpackage share: tables, pinned results, label folds, connected components."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from officelake.session import ensure_checkpoints, work_dir

#: What the contracts call a word: a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Arrow batches end at this many bytes, so that very long texts cannot pile up in a task.
BATCH_BYTES = "8388608"
#: Rows up to which a side of a join is handed to every task; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pinned(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a result that survives lost executors."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """Only what the operators read, whatever other columns a table has; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has been counted to be small enough, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, label) per labelled document; of contradicting rows the larger label holds."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )


def bounded_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """``rows`` rows chosen by a hash of their key: the same ones at every run, whatever the partitioning.

    Rows are counted first and thinned by the hash to little more than ``rows``, so that no task hands on more than
    its share.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 31))
    if total > 2 * rows:
        df = df.where(place < int((1 << 31) * min(1.0, 1.5 * rows / total)))
    return df.orderBy(place, F.col(key)).limit(rows)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps; the last one is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + penalty * w
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b), both ways.

    First every node's neighbours are hung on the smallest of them, which leaves few more links than nodes where many
    nodes share neighbours. Then each round gives every node the smallest label around it and the label of that
    label. Rounds are checkpointed in the shared folder; their number follows the logarithm of the longest chain.
    """
    ensure_checkpoints(edges.sparkSession)
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    hung = pairs.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
    both = hung.unionByName(hung.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")).checkpoint()
    for _ in range(max_rounds):
        near = (
            both.join(label.select(F.col("node").alias("b"), "root"), "b")
            .select(F.col("a").alias("node"), "root")
            .unionByName(label)
            # the root of a node hears of what the node has heard
            .unionByName(
                both.join(label.select(F.col("node").alias("b"), F.col("root").alias("theirs")), "b")
                .join(label.select(F.col("node").alias("a"), F.col("root").alias("own")), "a")
                .where("theirs < own")
                .select(F.col("own").alias("node"), F.col("theirs").alias("root"))
            )
            .groupBy("node")
            .agg(F.min("root").alias("root"))
        )
        jumped = (
            near.join(near.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left")
            .select("node", F.coalesce("further", "root").alias("root"))
            .checkpoint()
        )
        moved = jumped.join(label.withColumnRenamed("root", "before"), "node").where("root <> before").limit(1).count()
        label = jumped
        if not moved:
            return label
    raise RuntimeError("components have not settled")
