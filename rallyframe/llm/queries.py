"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, contamination, langid, minhash, mixing, packing, passages, pii, quality, resampling, secrets, urls, warc
from .common import table


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, name = quality.judge(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return judged.select("doc_id", *[F.col(f"{name}.{c}").alias(c) for c in cols])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.substring_dedup(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(spark, table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", width=4, percent=80)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_language_id, op2_warc, op3_substring_dedup, op4_secret_scan, op5_pii, op6_mixing, op7_minhash_near_dedup, op8_url_filters),
        *(op9_quality_rules, op10_decontamination, op11_packing, op12_importance_resampling, op13_centroid_clustering),
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op4_secret_scan": secrets.SQL,
    "op6_mixing": mixing.SQL,
    "op7_minhash_near_dedup": minhash.sql(4, 80),
    "op8_url_filters": urls.SQL,
    "op12_importance_resampling": resampling.SQL,
    "op13_centroid_clustering": clustering.sql(),
}
