"""Where positives are lost: outcomes of each positive, by query, by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import overlap
from sieveline.operators.ranker import TOP_K

BUCKETS = (50, 100, 300)


def rank_bucket(rank: Column, uppers: tuple[int, ...] = BUCKETS) -> Column:
    """A label for the range that a rank lies in; not_in_pool for none."""
    out = F.when(rank.isNull(), "not_in_pool")
    for low, high in zip((0, *uppers), uppers):  # noqa: B905
        out = out.when(rank <= high, f"{low + 1}-{high}")
    return out.otherwise(f">{uppers[-1]}")


def positive_outcomes(contexts: DataFrame, ranked: DataFrame, items: DataFrame, stats: DataFrame, seen: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row for each (query, chosen item): whether it is in the pool and among the k best, and its slices.

    ``contexts``: query_id, query_text, search_loc, filters, item_ids; ``ranked``: the scored pool
    with model_rank; ``items``: doc_id, item_loc, params_set; ``seen``: item_id.
    """
    words = F.size(F.split("query_text", " ", -1))
    places = stats.select(F.col("loc").alias("search_loc"), F.lit(True).alias("has_center"))
    pairs = contexts.join(places, "search_loc", "left").select(
        "query_id", "search_loc", (F.col("filters") != "").alias("filters_set"), F.when(words >= 4, "4+").otherwise(words.cast("string")).alias("words"), F.coalesce("has_center", F.lit(False)).alias("has_center"), F.split(F.lower("filters"), " ").alias("_f"), F.explode("item_ids").alias("doc_id")
    )
    pairs = pairs.withColumn("n_pos", F.count("*").over(Window.partitionBy("query_id")))
    known = pairs.join(seen.select(F.col("item_id").alias("doc_id"), F.lit(True).alias("item_seen")).distinct(), "doc_id", "left").join(items.select("doc_id", "item_loc", "params_set"), "doc_id", "left")
    found = known.join(ranked.select("query_id", "doc_id", "rrf_rank", "model_rank", "n_lists", "dist_km", "loc_match"), ["query_id", "doc_id"], "left")
    return found.withColumns(
        {
            "item_seen": F.coalesce("item_seen", F.lit(False)), "same_location": F.col("item_loc") == F.col("search_loc"), "in_pool": F.col("model_rank").isNotNull(), "in_top": F.coalesce(F.col("model_rank") <= k, F.lit(False)),
            "filter_overlap": F.when(F.col("filters_set") & F.col("params_set").isNotNull(), overlap(F.array_distinct("_f"), F.col("params_set"))),
        }
    ).drop("_f", "params_set")


def query_outcomes(positives: DataFrame) -> DataFrame:
    """Recall and pool recall of each query with its slices."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return positives.groupBy("query_id", "words", "filters_set", "has_center").agg(F.count("*").alias("n_pos"), share("in_top").alias("recall"), share("in_pool").alias("pool_recall"), F.bool_or(~F.coalesce("same_location", F.lit(False))).alias("any_other_location"))


def _losses(n: Column) -> list[Column]:
    weight = 1.0 / (F.col("n_pos") * n)
    part = lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0.0))
    return [part(~F.col("in_pool")).alias("retrieval_loss"), part(F.col("in_pool") & ~F.col("in_top")).alias("selection_loss")]


GROUPS = {
    "same_location": lambda: F.col("same_location").cast("string"), "has_center": lambda: F.col("has_center").cast("string"), "words": lambda: F.col("words"), "filters_set": lambda: F.col("filters_set").cast("string"), "item_seen": lambda: F.col("item_seen").cast("string"),
    "n_lists": lambda: F.col("n_lists").cast("string"), "model_rank": lambda: rank_bucket(F.col("model_rank")), "multi_positive": lambda: (F.col("n_pos") > 1).cast("string"),
}


def loss_breakdown(positives: DataFrame, groups: dict | None = None) -> DataFrame:
    """by, group and its positives, queries, recall and losses, for all groupings in one grouping-sets pass.

    Losses are parts of the total, weighted by query; a null group is told apart from a rolled-up one.
    """
    groups = groups or GROUPS
    total = positives.agg(F.countDistinct("query_id").alias("_n"))
    rows = positives.join(F.broadcast(total)).select("query_id", "n_pos", "in_pool", "in_top", "_n", *(g().alias(f"_g_{n}") for n, g in groups.items()))  # one row
    share = lambda c: F.avg(F.col(c).cast("double"))
    cols = [f"_g_{n}" for n in groups]
    measures = [F.count("*").alias("positives"), F.countDistinct("query_id").alias("queries"), share("in_top").alias("recall"), share("in_pool").alias("pool_recall"), *_losses(F.col("_n"))]
    sets = rows.groupingSets([[F.col(c)] for c in cols], *(F.col(c) for c in cols)).agg(F.grouping_id(*(F.col(c) for c in cols)).alias("_gid"), *measures)
    full = 2 ** len(cols) - 1
    by, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, n in reversed(list(enumerate(groups))):
        mine = F.col("_gid") == full - 2 ** (len(cols) - 1 - k)
        by, group = F.when(mine, n).otherwise(by), F.when(mine, F.col(f"_g_{n}")).otherwise(group)
    return sets.select(by.alias("by"), group.alias("group"), "positives", "queries", "recall", "pool_recall", "retrieval_loss", "selection_loss")


def error_map(positives: DataFrame) -> DataFrame:
    """One row of totals: recall and the two losses add up to one."""
    rows = positives.join(F.broadcast(positives.agg(F.countDistinct("query_id").alias("_n"))))  # one row
    weight = 1.0 / (F.col("n_pos") * F.col("_n"))
    lost, pooled = ~F.col("in_top"), F.col("in_pool")
    return rows.agg(
        F.countDistinct("query_id").alias("queries"), F.count("*").alias("positives"), F.coalesce(F.sum(F.when(F.col("in_top"), weight)), F.lit(0.0)).alias("recall"), *_losses(F.col("_n")), F.countDistinct(F.when(~pooled, F.col("query_id"))).alias("queries_with_retrieval_miss"),
        F.countDistinct(F.when(pooled & lost, F.col("query_id"))).alias("queries_with_selection_miss"), F.avg(F.when(F.col("in_top"), F.col("filter_overlap"))).alias("overlap_kept"), F.avg(F.when(lost, F.col("filter_overlap"))).alias("overlap_lost"),
        F.median(F.when(F.col("in_top"), F.col("dist_km"))).alias("dist_kept"), F.median(F.when(pooled & lost, F.col("dist_km"))).alias("dist_lost"),
    )


def error_examples(positives: DataFrame, selected: DataFrame, order: Column, n: int = 20, top: int = 5) -> DataFrame:
    """Up to n queries with a lost positive, least ``order`` first, with their lost items and first selected ones."""
    lost = positives.where("not in_top").groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("lost_ids"))
    return lost.join(selected.select("query_id", F.slice("doc_ids", 1, top).alias("selected_ids")), "query_id").withColumn("_o", order).orderBy("_o", "query_id").limit(n).drop("_o")
