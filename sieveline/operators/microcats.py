"""Microcategory distributions of a query, taken over from similar past queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.dense import search

NEIGHBORS, TEMPERATURE, EXACT, DUPLICATE = 40, 0.05, 0.999, 0.998


def text_microcats(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of each microcategory among a text's choices that have one."""
    own = [*keys, "query_text"]
    counts = pairs.where("microcat is not null").groupBy(*own, "microcat").agg(F.count("*").alias("n"))
    return counts.select(*own, "microcat", (F.col("n") / F.sum("n").over(Window.partitionBy(*own))).alias("share"))


def softmax_weights(score: Column, by: str = "query_id", temperature: float = TEMPERATURE, exact: bool = False) -> Column:
    """Weights of a query's neighbours that sum to one.

    With ``exact``, where the best neighbour is the same text, only its duplicates count, equally.
    """
    w = Window.partitionBy(by)
    raw = F.exp((score - F.max(score).over(w)) / temperature)
    if exact:
        raw = F.when(F.max(score).over(w) >= EXACT, (score >= DUPLICATE).cast("double")).otherwise(raw)
    return raw / F.sum(raw).over(w)


def history_neighbors(texts: DataFrame, queries: DataFrame, pairs: DataFrame, k: int = NEIGHBORS, need_microcat: bool = False) -> DataFrame:
    """The k past texts nearest to each query among those that its view allows: query_id, view_id, query_text, score.

    ``texts``: query_text and embedding of past texts; ``queries``: query_id, view_id and embedding;
    ``pairs``: query_text, microcat and view_id of the choices that each view may see. With
    ``need_microcat`` a text counts only where one of its visible choices has a microcategory.
    """
    seen = pairs.where("microcat is not null") if need_microcat else pairs
    allowed = seen.select("view_id", "query_text").distinct().join(texts.select("query_text", "embedding"), "query_text")
    found = search(allowed.withColumnRenamed("query_text", "doc_id"), queries, k, "view_id")
    return found.join(queries.select("query_id", "view_id"), "query_id").select("query_id", "view_id", F.col("doc_id").alias("query_text"), "score")


def distribution(neighbors: DataFrame, shares: DataFrame, exact: bool = False, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """From (query_id, query_text, score) neighbours: (query_id, microcat, mc_prob), and per query the
    maximum, entropy, best similarity and whether the text itself is among them.

    With ``keys`` (view_id) a neighbour's shares are those that the query's view may see.
    """
    weighted = neighbors.withColumn("_w", softmax_weights(F.col("score"), exact=exact))
    prob = weighted.join(shares, [*keys, "query_text"]).groupBy("query_id", "microcat").agg(F.sum(F.col("_w") * F.col("share")).alias("mc_prob"))
    top = neighbors.groupBy("query_id").agg(F.max("score").alias("mc_top_sim"))
    entropy = -F.sum(F.when(F.col("mc_prob") > 0, F.col("mc_prob") * F.log("mc_prob")).otherwise(0.0))
    per_query = prob.groupBy("query_id").agg(F.max("mc_prob").alias("mc_max"), entropy.alias("mc_entropy")).join(top, "query_id")
    return prob, per_query.withColumn("mc_is_exact_match", (F.col("mc_top_sim") >= EXACT).cast("int"))


def microcat_features(frame: DataFrame, prob: DataFrame, per_query: DataFrame) -> DataFrame:
    """Adds mc_prob (0 if the microcategory is unlikely), its ratio to the best, entropy and best similarity."""
    joined = frame.join(prob, ["query_id", "microcat"], "left").join(per_query, "query_id", "left")
    return joined.withColumn("mc_prob", F.coalesce("mc_prob", F.lit(0.0))).withColumn("mc_ratio", F.try_divide(F.col("mc_prob"), F.col("mc_max"))).drop("mc_max")
