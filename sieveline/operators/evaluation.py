"""Recall, reports by slice, paired comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import stable_hash

KS = (50, 100, 300, 1000)
RESAMPLES = 5000


def recall_at_k(predicted: Column, relevant: Column, k: int) -> Column:
    """Share of the distinct relevant ids among the first k predicted; repeats are dropped after the cut."""
    wanted = F.array_distinct(relevant)
    found = F.size(F.array_intersect(F.slice(predicted, 1, k), wanted)) / F.size(wanted)
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, found).otherwise(F.raise_error(F.lit("a query without relevant items")).cast("double"))


def slices(words: Column) -> dict[str, Column]:
    return {"filters_empty": F.col("filters") == "", "filters_set": F.col("filters") != "", "category_0": F.col("category") == "0", "words_1": words == 1, "words_2": words == 2, "words_3": words == 3, "words_4plus": words >= 4}


def recall_report(predictions: DataFrame, queries: DataFrame, seen: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """metric, n and value: recall at each k, pool size, empty pools and recall at the first k by slice.

    ``queries``: query_id, query_text, filters, category, item_ids. The slice new_items counts only
    relevant items that aren't among ``seen`` (item_id).
    """
    first = ks[0]
    unseen = queries.select("query_id", F.explode("item_ids").alias("item_id")).join(seen.select("item_id").distinct(), "item_id", "left_anti").groupBy("query_id").agg(F.collect_set("item_id").alias("new_ids"))
    joined = queries.join(predictions, "query_id").join(unseen, "query_id", "left")
    words = F.size(F.split("query_text", " ", -1))
    base = joined.select("*", *(recall_at_k(F.col("doc_ids"), F.col("item_ids"), k).alias(f"r{k}") for k in ks), F.when(F.col("new_ids").isNotNull(), F.size(F.array_intersect(F.slice("doc_ids", 1, first), F.col("new_ids"))) / F.size("new_ids")).alias("rnew"))
    rows = [(f"recall@{k}", F.count("*"), F.avg(f"r{k}")) for k in ks]
    rows += [("mean_pool_size", F.count("*"), F.avg(F.size("doc_ids").cast("double"))), ("empty_pools", F.count("*"), F.sum((F.size("doc_ids") == 0).cast("double")))]
    rows += [(name, F.count_if(c), F.avg(F.when(c, F.col(f"r{first}")))) for name, c in slices(words).items()]
    rows += [("new_items", F.count("rnew"), F.avg("rnew"))]
    one = base.agg(F.array(*(F.struct(F.lit(m).alias("metric"), n.cast("long").alias("n"), v.alias("value")) for m, n, v in rows)).alias("a"))
    return one.select(F.inline("a"))


def per_query(predicted: DataFrame, k: int = KS[0]) -> DataFrame:
    """query_id, its slices, and recall of the first k and of the whole pool, for a run that is stored."""
    return predicted.select("query_id", "query_text", "filters", "category", recall_at_k(F.col("doc_ids"), F.col("item_ids"), k).alias("recall"), recall_at_k(F.col("doc_ids"), F.col("item_ids"), 2**31 - 1).alias("pool_recall"))


#: Largest number of copies of a row in a resample that its weights tell apart: more have probability 1e-6.
MOST_COPIES = 8


def poisson_weight(u: Column) -> Column:
    """How often a row is in a resample: the Poisson quantile (mean 1) of a uniform number."""
    weight, below, term = F.lit(0), 0.0, float(np.exp(-1.0))
    for k in range(MOST_COPIES):
        below, term = below + term, term / (k + 1)
        weight = weight + (u >= below).cast("int")
    return weight


def bootstrap(diffs: DataFrame, by: tuple[str, ...] = (), resamples: int = RESAMPLES) -> DataFrame:
    """n, mean difference and its 95 per cent percentile interval for each group of ``diffs`` (query_id, diff).

    Nothing is collected: each row has a Poisson weight for each resample, made of a hash of its id and
    the resample, and weighted sums are added up in each task, so what is shuffled is one row for each
    group, resample and task. The same rows give the same interval in any order.
    """
    # differences of recalls are small fractions: in whole billionths a sum doesn't depend on its order
    units = F.round(F.col("diff") * 10**9).cast("long")
    own = diffs.groupBy("query_id").agg(F.collect_list(F.struct(*by, units.alias("units"))).alias("rows"))  # a row for each group that a query is in
    u = (stable_hash(F.concat_ws("/", F.col("query_id").cast("string"), F.col("resample").cast("string")), "bootstrap") % 1_000_003 + F.lit(0.5)).cast("double") / 1_000_003
    draws = own.select("query_id", "rows", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).select("resample", "rows", poisson_weight(u).alias("w")).where("w > 0")
    sums = draws.select("resample", "w", F.inline("rows")).groupBy(*by, "resample").agg(F.sum(F.col("w") * F.col("units")).alias("s"), F.sum("w").alias("n"))
    means = sums.withColumn("m", F.try_divide(F.col("s"), F.col("n")) / 10**9)
    limits = means.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    whole = diffs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("diff").alias("diff"))
    return whole.join(limits, list(by)) if by else whole.crossJoin(limits)  # one row each


def verdict(low: Column, high: Column) -> Column:
    """What an interval says about a difference."""
    return F.when(low > 0, "better").when(high < 0, "worse").otherwise("undetermined")


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id and the two runs' recalls; raises unless both hold the same queries once each."""
    joined = a.select("query_id", F.col("recall").alias("recall_a"), F.col("pool_recall").alias("pool_a")).join(b.select("query_id", F.col("recall").alias("recall_b"), F.col("pool_recall").alias("pool_b"), F.lit(1).alias("_b")), "query_id", "full_outer")
    if not joined.where("recall_a is null or _b is null").isEmpty() or not joined.groupBy("query_id").count().where("count > 1").isEmpty():
        raise ValueError("the runs hold different queries")
    return joined.drop("_b")


def compare_runs(a: DataFrame, b: DataFrame, resamples: int = RESAMPLES, masks: dict[str, Column] | None = None) -> DataFrame:
    """slice, n, diff, low, high and verdict of run a against run b: overall, for the pool, and by slices of the queries.

    ``masks`` (name -> condition on a's columns) replaces the usual slices of query_text, filters and category.
    """
    words = F.size(F.split("query_text", " ", -1))
    masks = slices(words) if masks is None else masks
    named = a.select("query_id", F.array_compact(F.array(F.lit("overall"), *(F.when(c, F.lit(n)) for n, c in masks.items()))).alias("slices"))
    rows = aligned(a, b).join(named, "query_id")
    recall = rows.select("query_id", F.explode("slices").alias("slice"), (F.col("recall_a") - F.col("recall_b")).alias("diff"))
    pool = rows.select("query_id", F.lit("pool").alias("slice"), (F.col("pool_a") - F.col("pool_b")).alias("diff"))
    found = bootstrap(recall.unionByName(pool), ("slice",), resamples)
    return found.withColumn("verdict", verdict(F.col("low"), F.col("high"))).select("slice", "n", "diff", "low", "high", "verdict")


def average_runs(runs: list[DataFrame]) -> DataFrame:
    """Mean recall of each query over several runs of the same queries."""
    union = runs[0].select("query_id", "recall")
    for r in runs[1:]:
        union = union.unionByName(r.select("query_id", "recall"))
    out = union.groupBy("query_id").agg(F.avg("recall").alias("recall"), F.count("*").alias("n"))
    if not out.where(F.col("n") != len(runs)).isEmpty():
        raise ValueError("a query is missing from a run or repeated in it")
    return out.drop("n")
