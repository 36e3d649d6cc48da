"""Session set-up and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench; on a cluster, spark-submit supplies the settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("officelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on; sizing is left to whoever owns the session. Call it once per session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A union that claims the partitioning of its branches is wrong once AQE has coalesced a branch's
    # repartition on its own: equal keys then lie in different partitions (seen with Spark 4.1.2).
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # Shuffles start with more partitions than the session's number, and AQE joins them up to its advisory size: what a
    # task sorts or hashes then follows that size, not the input's. An owner's own setting stays.
    start, own = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "officelake.initialPartitionNum"
    if spark.conf.get(start, None) == spark.conf.get(own, None):
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for name in (start, own):
            spark.conf.set(name, str(max(partitions, min(16 * partitions, 1000))))
    # Processors with state of their own need a store that keeps several kinds of it.
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A local session may leave it unset and then gets a temporary folder; a cluster may not.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = os.environ.get("OFFICELAKE_LOCAL_ROOT")
    if not root:
        root = tempfile.mkdtemp(prefix="officelake-")
        os.environ["OFFICELAKE_LOCAL_ROOT"] = root
    return root


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused sub-folder of the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def pin_columns(df: DataFrame) -> DataFrame:
    """Keep rows in the shared folder as compressed columns, of which what follows reads those it needs."""
    path = work_dir(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable without overriding a directory the cluster has set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
