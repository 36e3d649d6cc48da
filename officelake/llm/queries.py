"""The dealt operators bound to the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from officelake.llm import codes, decontamination, jaccard, lexical, licenses, mixing, pii, quality, secrets, sharding, substrings, toxicity
from officelake.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document and the forest's verdict."""
    stats = quality.measured(table(spark, sf_dir, "documents"))
    forest = quality.fit_forest(stats, table(spark, sf_dir, "labels"))
    return quality.judged(stats, forest).select("doc_id", *quality.BASE, "base_failed", "kept", "anomaly")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases of every document, the rules' labels and the surest detection."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    listed = lambda *columns: F.array_join(
        F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda s: s["label"]) for c in columns]))), ","
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda s: s["start"])).alias("last_word"),
        listed("base").alias("base_labels"),
        listed("base", "found").alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)),
            F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)),
        ).alias("score"),
    )


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a 400-byte string found elsewhere covers, and what remains.

    ``shared_words`` counts the words in passages of over 50 words that another document has too, of whatever bytes.
    """
    found = substrings.deduplicated(table(spark, sf_dir, "documents"), words=substrings.WORDS)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("repeated"),
        "shared_words",
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as pairs."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows whose crc32 is 0 modulo 5 are held out of training."""
    stats = quality.measured(table(spark, sf_dir, "documents"))
    model = quality.fit_quality(stats, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) == 0)
    return quality.quality_scores(stats, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base matches and those of the field."""
    docs = table(spark, sf_dir, "documents")
    found = pii.scan(docs, pii.fit(docs))
    of = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base matches and those of the Markov models."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    of = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows whose crc32 is 2 modulo 4 are held out of training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold(F.col("doc_id"), 4) == 2)
    return toxicity.scores(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by their word shingles."""
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors and their errors."""
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it, by equal counts along the curve."""
    found = sharding.placed(table(spark, sf_dir, "documents"), 8, "rows")
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_licenses": op2_licenses,
    "op3_substrings": op3_substrings,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_lexical_search": op11_lexical_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_sharding": op13_sharding,
}

SQL: dict[str, str] = {
    "op4_mixing": f"WITH {mixing.MIX_SQL.format(docs='documents')} "
    "SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken",
    "op11_lexical_search": lexical.SEARCH_SQL,
    "op12_vector_codes": codes.codes_sql(),
}
