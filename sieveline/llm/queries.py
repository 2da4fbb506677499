"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bagminhash, bpe, common, decontam, langfilter, licenses, mil, ngram_lm, risk_rules, urlfilter, wavelet


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "tokens")
    wavelet.write_tokens(_read(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"))
    return wavelet.read_digests(spark, path)


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = common.held_out(F.col("doc_id"), 5, 0)
    model = langfilter.fit(docs.where(~fold).select("text", "lang"))
    found = langfilter.predict(docs.select("doc_id", "text"), model)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_read(spark, sf_dir, "documents"))


def op7_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = common.held_out(F.col("doc_id"), 5, 0)
    model = mil.fit(docs.where(~fold), _read(spark, sf_dir, "labels").where(~fold))
    found = mil.predict(docs, model)
    predicted = F.when(F.col("quality_score") >= mil.THRESHOLD, 1).otherwise(0)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), F.col("quality_score").alias("score"), predicted.alias("predicted"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is the URLs of the pages whose id is divisible by 100, looked up in all pages."""
    pages = _read(spark, sf_dir, "pages")
    return urlfilter.judge(pages, pages.where("page_id % 100 = 0").select("url"))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


QUERIES = (op1_wavelet_tokens, op2_bagminhash, op3_risk_rules, op4_language_filter, op5_license_digests, op6_backoff_automaton, op7_attention_mil, op8_url_filter, op9_template_decontamination, op10_bpe)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_license_digests": licenses.ORACLE, "op8_url_filter": urlfilter.ORACLE}
