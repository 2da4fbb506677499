"""Signals from past choices: item means, neighbour centroids, ranks of cosines, core places."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.numeric import dot
from sieveline.operators.microcats import softmax_weights

CORE_MASS = 0.9


def _vectors(rows: DataFrame, keys: list[str], kind: str, weight: str | None = None) -> DataFrame:
    """Element-wise ``mean`` or ``sum`` of ``embedding`` for each key, weighted or not; partial sums are made before the shuffle."""
    vector = array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
    metric = getattr(Summarizer, kind)
    value = metric(F.col("_v"), F.col(weight)) if weight else metric(F.col("_v"))
    cells = rows.where("embedding is not null").withColumn("_v", vector).groupBy(*keys).agg(value.alias("_s"))
    return cells.select(*keys, vector_to_array("_s").alias("embedding"))


def text_item_means(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Mean embedding of each text's distinct chosen items; the same choice seen in several views counts once."""
    distinct = pairs.select("query_text", "item_id").distinct()
    return _vectors(distinct.join(items.select("item_id", "embedding"), "item_id"), ["query_text"], "mean")


def neighbor_centroids(neighbors: DataFrame, means: DataFrame) -> DataFrame:
    """Softmax-weighted mean of the neighbours' item means, of unit length (zero stays zero)."""
    weighted = neighbors.withColumn("_w", softmax_weights(F.col("score"))).join(means, "query_text")
    sums = _vectors(weighted, ["query_id"], "sum", "_w")
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return sums.withColumn("_n", norm).select("query_id", F.transform("embedding", lambda x: F.coalesce(F.try_divide(x, F.col("_n")), F.lit(0.0))).alias("embedding"))


def rank_within(frame: DataFrame, score: str, name: str, digits: int = 9) -> DataFrame:
    """Ordinal rank by descending score; equal scores by the pool's own order."""
    w = Window.partitionBy("query_id").orderBy(F.round(score, digits).desc_nulls_last(), "rrf_rank")
    return frame.withColumn(name, F.row_number().over(w))


def cosine_features(frame: DataFrame, vectors: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: inner product of the query's vector and the item's, and its rank; 0 without a vector."""
    joined = frame.join(vectors.select("query_id", F.col("embedding").alias("_q")), "query_id", "left").join(items.select(F.col("item_id").alias("doc_id"), F.col("embedding").alias("_d")), "doc_id", "left")
    return rank_within(joined.withColumn(name, F.coalesce(dot(F.col("_q"), F.col("_d")), F.lit(0.0))).drop("_q", "_d"), name, f"{name}_rank")


def region_core(counts: DataFrame, mass: float = CORE_MASS) -> DataFrame:
    """For each searched place the item places, most frequent first, before which less than ``mass`` lies."""
    order = Window.partitionBy("search_loc").orderBy(F.desc("n"), "item_loc").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0)) / F.sum("n").over(Window.partitionBy("search_loc"))
    return counts.withColumn("mass_before", before).where(F.col("mass_before") < mass)
