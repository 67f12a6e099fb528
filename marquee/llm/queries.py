"""The registered queries: every operator over its whole table, by operator number."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe, quality_classifier
from marquee.llm.chat import formatted, read_back
from marquee.llm.checks import ORACLES  # noqa: F401
from marquee.llm.common import crc_of_id, table
from marquee.llm.decontaminate import contaminated
from marquee.llm.language_id import fit, identify
from marquee.llm.licenses import licenses
from marquee.llm.lm_scores import lm_scores
from marquee.llm.manifest import document_manifest
from marquee.llm.near_dedup import near_duplicates
from marquee.llm.quality import quality
from marquee.llm.repair import token_files
from marquee.llm.secrets import secrets
from marquee.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_superminhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicates(table(spark, folder, "documents"), size=3, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op2_credential_linking(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.concat_ws(",", "base_spans"), 256).alias("base_sha256"),
        F.concat_ws(",", "spans").alias("spans"),
    )


def op3_pigeonhole_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_quality_outliers(spark: SparkSession, folder: str) -> DataFrame:
    verdicts, _ = quality(table(spark, folder, "documents"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "distance", "kept",
    )


def op5_bpe_merge_replay(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", *bpe.digests())


def op6_license_expressions(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses(table(spark, folder, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op7_naive_bayes_language(spark: SparkSession, folder: str) -> DataFrame:
    rest = F.coalesce(F.pmod(crc_of_id(), F.lit(3)), F.lit(0))
    docs = table(spark, folder, "documents").withColumn("held_out", rest == 1)
    model = fit(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op8_repair_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_chat_templates(spark: SparkSession, folder: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, folder, "conversations").select(*own.columns)
    return read_back(formatted(turns.unionByName(own)))


def op10_pitman_yor_scores(spark: SparkSession, folder: str) -> DataFrame:
    rest = F.coalesce(F.pmod(crc_of_id(), F.lit(10)), F.lit(1))
    scores = lm_scores(table(spark, folder, "documents"), rest != 0)
    return scores.select("doc_id", (rest == 0).alias("held_out"), *scores.columns[1:])


def op11_lanczos_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows, model, error = whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(float(part)) for part in (model.explained if model else [])]).cast("array<double>")
    each = rows.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened"))
    return each.select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col").alias("whitened"),
        F.get(explained, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return document_manifest(table(spark, folder, "documents"))


def op13_naive_bayes_support_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rest = F.coalesce(F.pmod(crc_of_id(), F.lit(5)), F.lit(1))
    docs = table(spark, folder, "documents").select("doc_id", "text", (rest == 0).alias("held_out"))
    labels = table(spark, folder, "labels").select("doc_id", "quality").where(rest != 0)
    model = quality_classifier.fit(docs.where("NOT held_out"), labels)
    scores = quality_classifier.scored(docs, model).drop("text")
    return scores.withColumn("predicted", quality_classifier.predicted())


QUERIES: dict[str, Query] = {
    build.__name__: build
    for build in (
        op1_superminhash_near_dedup,
        op2_credential_linking,
        op3_pigeonhole_decontamination,
        op4_quality_outliers,
        op5_bpe_merge_replay,
        op6_license_expressions,
        op7_naive_bayes_language,
        op8_repair_token_files,
        op9_chat_templates,
        op10_pitman_yor_scores,
        op11_lanczos_whitening,
        op12_merkle_manifest,
        op13_naive_bayes_support_vectors,
    )
}
