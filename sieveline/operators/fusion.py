"""Ranked lists in long form: ordering, penalties for distance, rank fusion and the candidate pool."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
DIGITS = 12


def order_hits(hits: DataFrame, digits: int = 9) -> DataFrame:
    """Rank by score, equal scores by id."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", digits).desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w))


def geo_rerank(hits: DataFrame, query_loc: Column, item_loc: Column, weight: float = 1.0, delta: float = 0.0) -> DataFrame:
    """Items of another (or an unknown) place get score x weight - delta; then hits are ranked anew."""
    away = ~F.coalesce(query_loc == item_loc, F.lit(False))
    return order_hits(hits.withColumn("score", F.when(away, F.col("score") * weight - delta).otherwise(F.col("score"))))


def named(hits: DataFrame, name: str, depth: int) -> DataFrame:
    return hits.where(F.col("rank") <= depth).select("query_id", "doc_id", F.lit(name).alias("list"), "rank", "score")


def union_lists(lists: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """All lists in one table, each cut at its depth."""
    if not lists:
        raise ValueError("no lists to fuse")
    return reduce(DataFrame.unionByName, (named(hits, name, depth) for name, (hits, depth) in lists.items()))


def rrf_fuse(runs: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over the runs, best first, equal sums by id."""
    if len({r.select("query_id").distinct().count() for r in runs}) > 1:
        raise ValueError("runs have different numbers of queries")
    terms = reduce(DataFrame.unionByName, (r.select("query_id", "doc_id", (1.0 / (k + F.col("rank"))).alias("t")) for r in runs))
    fused = terms.groupBy("query_id", "doc_id").agg(F.round(F.sum("t"), DIGITS).alias("rrf"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(w))


def candidate_pool(lists: dict[str, tuple[DataFrame, int]], k: int = RRF_K, names: list[str] | None = None) -> DataFrame:
    """One row for each candidate: a rank and score column for each list, rrf, n_lists and rrf_rank.

    ``names`` fixes the columns: lists that aren't given become null columns. The rank columns are
    summed in that order, so the sum doesn't depend on how rows are dealt.
    """
    names = names or list(lists)
    wide = union_lists(lists).groupBy("query_id", "doc_id").pivot("list", names).agg(F.first("rank").alias("rank"), F.first("score").alias("score"))
    wide = wide.select("query_id", "doc_id", *(F.col(f"{n}_{c}").alias(f"{c}_{n}") for n in names for c in ("rank", "score")))
    ranks = [F.col(f"rank_{n}") for n in names]
    rrf = reduce(Column.__add__, (F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks))
    n_lists = reduce(Column.__add__, (r.isNotNull().cast("int") for r in ranks))
    pool = wide.withColumns({"rrf": F.round(rrf, DIGITS), "n_lists": n_lists})
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "doc_id")
    return pool.withColumn("rrf_rank", F.row_number().over(w))


def pool_size_stats(pool: DataFrame) -> DataFrame:
    """queries, mean and 95th percentile of the number of candidates."""
    sizes = pool.groupBy("query_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("queries"), F.avg("n").alias("mean_size"), F.percentile("n", 0.95).alias("p95_size"))


def pool_rows(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query's candidates in rrf order; empty arrays for queries without any."""
    own = pool.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rrf_rank", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    empty = F.array().cast(own.schema["doc_ids"].dataType)
    return queries.select("query_id").join(own, "query_id", "left").withColumn("doc_ids", F.coalesce("doc_ids", empty))
