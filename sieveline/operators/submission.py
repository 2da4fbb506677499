"""Answers: joining ids, reading them back, listing every violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER_K = 50
ID_LENGTH = 16
ITEM_ID = f"^[0-9a-f]{{{ID_LENGTH}}}$"


def answer_frame(selected: DataFrame, k: int = ANSWER_K) -> DataFrame:
    """query_id and its first k ids joined by spaces."""
    return selected.select("query_id", F.array_join(F.transform(F.slice("doc_ids", 1, k), lambda x: x.cast("string")), " ").alias("answer"))


def validate_answer(answer: DataFrame, queries: DataFrame, items: DataFrame, k: int = ANSWER_K, id_length: int = ID_LENGTH, item_id: str = ITEM_ID) -> DataFrame:
    """query_id and violation, one row for each; none for a valid answer.

    Of one answer only the first of these counts: empty, too many, repeated, malformed or unknown items.
    """
    if answer.columns != ["query_id", "answer"] or any(t != "string" for _, t in answer.dtypes):
        spark = answer.sparkSession
        return spark.createDataFrame([(None, f"schema {answer.dtypes}")], "query_id string, violation string")
    ids = answer.groupBy("query_id").count()
    wanted = queries.select(F.col("query_id").cast("string")).distinct()
    found = F.split(F.coalesce("answer", F.lit("")), " ")
    rows = answer.select("query_id", "answer", found.alias("ids"))
    outside = rows.select("query_id", "answer", F.explode("ids").alias("item_id")).join(items.select(F.col("item_id").cast("string")).distinct(), "item_id", "left_anti").select(F.col("query_id").alias("_q"), F.col("answer").alias("_a")).distinct().withColumn("outside", F.lit(True))
    marked = rows.join(outside, F.col("query_id").eqNullSafe(F.col("_q")) & F.col("answer").eqNullSafe(F.col("_a")), "left")
    malformed = F.exists("ids", lambda x: ~x.rlike(item_id)) | F.coalesce("outside", F.lit(False))
    kind = F.when(F.coalesce("answer", F.lit("")) == "", "empty").when(F.size("ids") > k, "too many items").when(F.size(F.array_distinct("ids")) < F.size("ids"), "duplicate items").when(malformed, "malformed or outside")
    parts = [
        ids.where("count > 1").select("query_id", F.lit("duplicate query").alias("violation")),
        wanted.join(ids, "query_id", "left_anti").select("query_id", F.lit("missing query").alias("violation")),
        ids.join(wanted, "query_id", "left_anti").select("query_id", F.lit("extra query").alias("violation")),
        ids.where(F.coalesce(F.length("query_id") != id_length, F.lit(True))).select("query_id", F.lit("query id length").alias("violation")),
        marked.select("query_id", kind.alias("violation")).where("violation is not null"),
    ]
    return reduce(DataFrame.unionByName, parts)
