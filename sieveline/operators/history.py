"""History of choices: cross-fitted views, transitions between places, geographic fallback.

A view says which queries are judged by which part of the history. Views are a key column on both
sides (view_id), so cross-fitting is one plan of keyed joins and never a loop over folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.numeric import clip, haversine_km
from sieveline.operators.split import FOLDS, text_fold

ALPHA = 10.0
UNRELIABLE_KM, UNRELIABLE_PAIRS, MAX_KM = 75.0, 5, 1000.0


def history_pairs(contexts: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each (context, chosen item) with the item's place, microcategory and coordinates, and the text's fold."""
    chosen = contexts.select("query_text", "search_loc", F.explode("item_ids").alias("item_id")).dropna(subset=["item_id"])
    attributes = items.select("item_id", F.col("loc").alias("item_loc"), "microcat", "lat", "lon")
    return chosen.join(attributes, "item_id").withColumn("fold", text_fold(F.col("query_text")))


def crossfit_queries(queries: DataFrame, holdout: DataFrame, folds: int = FOLDS) -> DataFrame:
    """view_id of each query: its text's fold, or ``folds`` for held-out texts, which see the whole history."""
    held = queries.join(holdout.select("query_text").distinct(), "query_text", "left_semi").withColumn("view_id", F.lit(folds))
    rest = queries.join(holdout.select("query_text").distinct(), "query_text", "left_anti").withColumn("view_id", text_fold(F.col("query_text"), folds))
    return rest.unionByName(held)


def crossfit_pairs(pairs: DataFrame, holdout: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Each pair in every view that may see it: those of the other folds, and the last one. Held-out texts are in none."""
    kept = pairs.join(holdout.select("query_text").distinct(), "query_text", "left_anti")
    return kept.withColumn("view_id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda v: v != F.col("fold"))))


def full_view(df: DataFrame) -> DataFrame:
    """Everything in one view."""
    return df.withColumn("view_id", F.lit(0))


def benchmark_history(log_contexts: DataFrame, items: DataFrame) -> DataFrame:
    """What queries of no past text may see: all choices of the whole log, in one view."""
    return full_view(history_pairs(log_contexts, items))


def union_of_views(pairs: DataFrame) -> DataFrame:
    """Each choice that any view may see, once."""
    return pairs.drop("view_id").distinct()


def check_coverage(queries: DataFrame, viewed: DataFrame) -> None:
    """Every query must be in exactly one view."""
    bad = queries.select("query_id").join(viewed.groupBy("query_id").count(), "query_id", "full_outer").where("count is null or count <> 1")
    if not bad.isEmpty():
        raise ValueError("a query is in no view or in several")


def corpus_location_share(items: DataFrame) -> DataFrame:
    """Share of the corpus' items at each place."""
    total = items.where("loc is not null").agg(F.count("*").alias("total"))
    return items.groupBy("loc").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("loc", (F.col("n") / F.col("total")).alias("share"))  # one row


def transitions(pairs: DataFrame, share: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Counts of (search place, item place), and for each search place the support and targets inside the corpus and the share outside it."""
    own = [*keys, "search_loc"]
    counts = pairs.groupBy(*own, "item_loc").agg(F.count("*").alias("n"))
    known = counts.join(share.select(F.col("loc").alias("item_loc"), F.lit(True).alias("inside")), "item_loc", "left")
    inside = F.coalesce("inside", F.lit(False))
    totals = known.groupBy(*own).agg(
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("support"), F.count_if(inside).alias("targets"), (F.sum(F.when(~inside, F.col("n")).otherwise(0)) / F.sum("n")).alias("outside_share")
    )
    return counts, totals


def transition_features(frame: DataFrame, counts: DataFrame, totals: DataFrame, share: DataFrame, keys: tuple[str, ...] = (), alpha: float = ALPHA) -> DataFrame:
    """Adds smoothed probability, unknown flag, lift, support, targets and outside share to (search_loc, item_loc) rows."""
    joined = frame.join(counts.withColumnRenamed("n", "_n"), [*keys, "search_loc", "item_loc"], "left").join(totals, [*keys, "search_loc"], "left").join(share.select(F.col("loc").alias("item_loc"), F.col("share").alias("_p")), "item_loc", "left")
    n, support, p = (F.coalesce(c, F.lit(0)) for c in ("_n", "support", "_p"))
    prob = (n + alpha * p) / (support + alpha)
    return joined.withColumns(
        {
            "trans_prob": prob, "trans_pairs": n, "trans_support": support, "trans_targets": F.coalesce("targets", F.lit(0)), "trans_unknown": (n == 0).cast("int"),
            "trans_lift": F.when(p > 0, F.log(1 + F.try_divide(prob, p))), "trans_outside_share": F.col("outside_share"),
        }
    ).drop("_n", "_p", "support", "targets", "outside_share")


def geo_fallback(frame: DataFrame, stats: DataFrame, centers: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """dist_km to the corpus' centre of the searched place or else the history's, where it came from, and the history's pairs and spread."""
    own = stats.select(F.col("loc").alias("search_loc"), F.col("lat").alias("_olat"), F.col("lon").alias("_olon"))
    past = centers.select(*keys, "search_loc", F.col("lat").alias("_hlat"), F.col("lon").alias("_hlon"), F.col("n_pairs").alias("_pairs"), F.col("spread_km").alias("hist_spread_km"))
    joined = frame.join(own, "search_loc", "left").join(past, [*keys, "search_loc"], "left")
    corpus_dist = haversine_km(F.col("_olat"), F.col("_olon"), F.col("lat"), F.col("lon"))
    hist_dist = haversine_km(F.col("_hlat"), F.col("_hlon"), F.col("lat"), F.col("lon"))
    source = F.when(F.col("_olat").isNotNull(), 0).when(F.col("_hlat").isNotNull(), 1).otherwise(2)
    return joined.withColumns({"dist_km": F.when(source == 0, corpus_dist).otherwise(hist_dist), "hist_dist_km": hist_dist, "center_source": source, "hist_pairs": F.coalesce("_pairs", F.lit(0))}).drop("_olat", "_olon", "_hlat", "_hlon", "_pairs")


def unreliable(source: Column, spread: Column, pairs: Column) -> Column:
    """A history centre that is spread out or rests on few pairs."""
    return (source == 1) & (F.coalesce(spread > UNRELIABLE_KM, F.lit(False)) | (pairs < UNRELIABLE_PAIRS))


def geo_damping(frame: DataFrame) -> DataFrame:
    """geo_unreliable and the logarithm of the distance, -1 where it isn't to be trusted."""
    missing = {"dist_km", "center_source", "hist_pairs", "hist_spread_km"} - set(frame.columns)
    if missing:
        raise ValueError(f"damping needs the fallback's columns: {sorted(missing)}")
    bad = unreliable(F.col("center_source"), F.col("hist_spread_km"), F.col("hist_pairs"))
    return frame.withColumns({"geo_unreliable": bad.cast("int"), "log_dist_clean": F.when(bad, F.lit(-1.0)).otherwise(F.log1p(clip(F.col("dist_km"), 0.0, MAX_KM)))})
