"""The corpus pipeline: language, quality, near-duplicates, benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir) and judges every row of what its predecessor kept. All
but the last return the columns of ``docs``; each result is written to the shared folder and
read again, so a lost executor costs no more than the stage it worked on.

* ``language_id`` drops documents that are ``und`` or whose best language explains less than
  ``MIN_SHARE`` of their n-grams.
* ``quality_classifier`` drops documents whose score is below the operator's threshold.
* ``near_dedup`` keeps the document with the least id of each class; documents without an id or
  without words are in no class and stay.
* ``decontamination`` drops documents that hold a benchmark item, also with other slot values.
* ``bpe`` encodes and decodes what is left: doc_id, n_tokens, ids_sha256, decoded_sha256.

Defined results: null and empty texts have no language and go in the first stage; rows without an id
teach nothing and stay as long as their text is clean; repeated rows are judged alike, and one of
equal id and text stays; very long texts are judged whole; other columns, whatever their names, are
passed on by all stages but the last; an empty table passes through empty; without labels of both
kinds the second stage judges by their share, and without any it keeps every document; without
benchmark items the fourth keeps every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bagminhash, bpe, common, decontam, langfilter, mil

MIN_SHARE = 0.2
TOKENIZER = "word_bpe_49k.json"


def _kept(judged: DataFrame, docs: DataFrame, rule: str) -> DataFrame:
    """Rows of ``judged`` that pass, with the columns of ``docs``."""
    return judged.where(rule).select(*(judged[f"`{c}`"] for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langfilter.fit(docs.where(~common.held_out(F.col("doc_id"), 5, 0)).select("text", "lang"))
    mark = _free(docs, "lang_pred"), _free(docs, "lang_score")
    return _kept(langfilter.predict(docs, model, names=mark), docs, f"{mark[0]} <> '{langfilter.UND}' and {mark[1]} >= {MIN_SHARE}")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fold = common.held_out(F.col("doc_id"), 5, 0)
    model = mil.fit(docs.where(~fold).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold))
    mark = _free(docs, "quality_score")
    return _kept(mil.predict(docs, model, name=mark), docs, f"{mark} >= {mil.THRESHOLD}")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path(TOKENIZER))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", encode)]

#: SQL can express neither the learnt stages nor byte-pair encoding; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return docs
