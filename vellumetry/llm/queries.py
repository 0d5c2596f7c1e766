"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85).drop("text_hash")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find

    return find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


#: The contract's rules.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest

    return digest(_table(spark, sf_dir, "documents"))


def op10_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import fit, scan

    docs = _table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import digest

    return digest(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import digest

    return digest(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import limited

    return limited(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_license_scan, op2_media_columns, op3_ngram_jaccard_join, op4_language_id, op5_warc_normaliser, op6_benchmark_decontamination, op7_url_filters, op8_source_mixing, op9_secret_scan, op10_pii_scan, op11_merkle_manifest, op12_fill_in_middle, op13_token_counts)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
