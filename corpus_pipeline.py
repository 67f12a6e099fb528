"""Documents to training data, in stages that each write their result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe
from marquee.llm.common import table, written
from marquee.llm.decontaminate import decontaminated
from marquee.llm.near_dedup import first_of_group
from marquee.llm.quality import quality_filter
from marquee.llm.secrets import redacted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a bound or lie far from those of their language and source go."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return first_of_group(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, and the number of characters follows the text."""
    masked = redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian 32-bit numbers) in the place of the texts; what
    doesn't decode to its text is an error."""
    text = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    coded = bpe.encode_decode(text, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.sha2("decoded", 256) == F.col("text_sha256")
    checked = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to their text")).cast("binary"))
    n_tokens, ids_sha256, _ = bpe.digests()
    return coded.withColumn("ids", checked).select(
        *[c for c in docs.columns if c != "text"], "ids", n_tokens, ids_sha256
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

# The robust covariance, signatures and merges are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
