"""The operators over their whole tables, as registered queries, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, jaccard_join, licenses, linededup, quality, quality_net, secrets, sharding, spelling, toxicity, vectorcodes, warc
from .common import table
from .sql import ORACLES

#: Path of the tokenizer file; it is read on the driver only.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 16


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents")).drop("clean")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.removals(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("stratum")


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages' records in which stated records are damaged: of ids whose
    number (the first seven hexadecimal digits of the id's MD5) mod 97 is 0 one byte is changed, mod
    97 is 1 the record is lost."""
    primary = warc.records(table(spark, sf_dir, "pages"))
    fate = F.pmod(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 7), 16, 10).cast("long"), F.lit(97))
    hurt = F.expr("concat(substring(bytes, 1, 40), X'00', substring(bytes, 42, octet_length(bytes)))")
    replica = primary.withColumn("fate", fate).filter("fate <> 1").select("volume", "id", F.when(F.col("fate") == 0, hurt).otherwise(F.col("bytes")).alias("bytes"))
    leaves, _, _ = warc.audit(primary, replica)
    return leaves.select(F.col("id").alias("page_id"), "volume", "seq", "offset", "length", "record_sha256", "status", "shift")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.items_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vectorcodes.coded(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.lit(books.text() if books else "").cast("binary"), 256)
    return vectorcodes.with_label_error(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_jaccard_join, op2_sharding, op3_toxicity, op4_secret_scan, op5_bpe, op6_line_dedup, op7_quality_rules, op8_warc_fixity, op9_decontamination, op10_license_scan, op11_vector_codes, op12_spelling_variants, op13_quality_classifier]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
