"""One query for each operator of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"))
    model, counts = train(docs.filter(~F.col("held_out")))
    return score(docs, model, counts)


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simple8b import encode_and_read_back
    from .tokens import vocabulary

    return encode_and_read_back(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import report

    return report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed
    from .tokens import vocabulary

    return packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"), passages=True)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    return predict(docs, train(docs.filter(~held_out)), held_out)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    return assess(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_simple8b": op2_simple8b,
    "op3_secret_scan": op3_secret_scan,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {}
