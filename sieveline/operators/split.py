"""Leakage-free splits by hash, query contexts and evaluation samples.

Every choice is a function of a stable hash, never of row order, so plans may be re-partitioned
or recomputed freely. Samples are a top-n by hash, a bounded heap in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import SEPARATOR, digest_id, stable_hash

SEED = "42"
EVAL_QUERIES = 2452
FOLDS = 5


def part_of(text: Column, seed: str = SEED) -> Column:
    """train, dev or test: 80, 10 and 10 per cent of the texts."""
    bucket = stable_hash(text, seed) % 10_000
    return F.when(bucket < 8000, "train").when(bucket < 9000, "dev").otherwise("test")


def assign_parts(texts: DataFrame, seed: str = SEED) -> DataFrame:
    """Each distinct query text and its part."""
    return texts.select("query_text").distinct().withColumn("part", part_of(F.col("query_text"), seed))


def text_fold(text: Column, folds: int = FOLDS, seed: str = SEED) -> Column:
    return (stable_hash(F.concat(F.lit(f"history{SEPARATOR}"), text), seed) % folds).cast("int")


def valid_bucket(text: Column, share: int = 100, seed: str = SEED) -> Column:
    """Whether a text is in the ranker's validation bucket: ``share`` of 1000."""
    return (stable_hash(F.concat(F.lit(f"valid{SEPARATOR}"), text), seed) % 1000) < share


def build_contexts(pairs: DataFrame, keys: list[str], item: str = "item_id") -> DataFrame:
    """One row for each query context with its sorted distinct items and an id of sixteen digits."""
    grouped = pairs.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("item_ids"))
    return grouped.withColumn("query_id", digest_id(*(F.col(k) for k in keys)))


def build_corpus(pairs: DataFrame, item: str = "item_id") -> DataFrame:
    """One row for each item; the least of its rows, so the choice is the same in any order."""
    rest = [c for c in pairs.columns if c != item]
    return pairs.groupBy(item).agg(F.min(F.struct(*rest)).alias("r")).select(item, *(F.col("r")[c].alias(c) for c in rest))


def sample_queries(contexts: DataFrame, n: int = EVAL_QUERIES, seed: str = SEED) -> DataFrame:
    """n texts by least hash, then each text's context with the least hash of its id."""
    texts = contexts.select("query_text").distinct().withColumn("h", stable_hash(F.concat(F.lit(f"text{SEPARATOR}"), F.col("query_text")), seed))
    chosen = texts.orderBy("h", "query_text").limit(n).select("query_text")
    first = Window.partitionBy("query_text").orderBy(stable_hash(F.col("query_id"), seed), "query_id")
    return contexts.join(chosen, "query_text", "left_semi").withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def repeated_text_queries(contexts: DataFrame, excluded: DataFrame, n: int, seed: str = SEED) -> DataFrame:
    """A sample among the texts of two or more contexts that aren't excluded."""
    repeated = contexts.groupBy("query_text").count().where("count >= 2").select("query_text").join(excluded, "query_text", "left_anti")
    return sample_queries(contexts.join(repeated, "query_text", "left_semi"), n, seed)


def fixed_valid_texts(contexts: DataFrame, n: int = 6000, share: int = 100, seed: str = SEED) -> DataFrame:
    """Texts of a sample that lie in the validation bucket."""
    return sample_queries(contexts, n, seed).select("query_text").where(valid_bucket(F.col("query_text"), share, seed))


def roles(queries: DataFrame, valid: DataFrame, share: int = 100, seed: str = SEED) -> DataFrame:
    """valid: in the fixed set; excluded: in the bucket but not in the set."""
    marked = queries.join(valid.select("query_text").distinct().withColumn("valid", F.lit(True)), "query_text", "left")
    marked = marked.withColumn("valid", F.coalesce("valid", F.lit(False)))
    return marked.withColumn("excluded", valid_bucket(F.col("query_text"), share, seed) & ~F.col("valid"))


def disjoint(parts: DataFrame) -> bool:
    """Whether no text is in two parts."""
    return parts.groupBy("query_text").agg(F.countDistinct("part").alias("n")).where("n > 1").isEmpty()
