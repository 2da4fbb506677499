"""The query-item feature table: base features, labels, the feature contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.numeric import haversine_km
from sieveline.functions.stem import stem_set
from sieveline.functions.text import overlap, space_words, token_set

PARAMS_CHARS = 500
BASE_FEATURES = ["title_overlap", "params_overlap", "loc_match", "cat_match", "dist_km", "query_cat_zero", "filters_empty", "query_words", "location_items", "price", "title_chars", "params_chars", "rrf", "rrf_rank", "n_lists"]


def item_table(items: DataFrame, stem: bool = False) -> DataFrame:
    """Items with their token sets (of stems with ``stem``) and lengths, computed once for all queries."""
    terms = lambda text: stem_set(token_set(text)) if stem else token_set(text)
    params = F.substring(F.coalesce("params", F.lit("")), 1, PARAMS_CHARS)
    return items.select(
        F.col("item_id").alias("doc_id"), F.col("loc").alias("item_loc"), F.col("category").alias("item_category"), "microcat", "price", "lat", "lon", terms(F.col("title")).alias("title_set"), terms(params).alias("params_set"),
        F.length(F.coalesce("title", F.lit(""))).alias("title_chars"), F.length(F.coalesce("params", F.lit(""))).alias("params_chars"),
    )


def build_features(pool: DataFrame, queries: DataFrame, items: DataFrame, stats: DataFrame, stem: bool = False) -> DataFrame:
    """Base features of every candidate. ``queries``: query_id, query_text, search_loc, filters, category.

    Overlaps are those of words or, with ``stem``, of their stems.
    """
    words = token_set(F.col("query_text"))
    own = queries.select("query_id", "query_text", "search_loc", "filters", F.col("category").alias("query_category"), (stem_set(words) if stem else words).alias("_words"))
    place = stats.select(F.col("loc").alias("search_loc"), F.col("lat").alias("_clat"), F.col("lon").alias("_clon"), F.col("n_items").alias("_n"))
    joined = pool.join(own, "query_id").join(item_table(items, stem), "doc_id").join(place, "search_loc", "left")
    return joined.withColumns(
        {
            "title_overlap": overlap(F.col("_words"), F.col("title_set")), "params_overlap": overlap(F.col("_words"), F.col("params_set")), "loc_match": (F.col("item_loc") == F.col("search_loc")).cast("int"), "cat_match": (F.col("item_category") == F.col("query_category")).cast("int"),
            "dist_km": haversine_km(F.col("_clat"), F.col("_clon"), F.col("lat"), F.col("lon")), "query_cat_zero": F.coalesce((F.col("query_category") == "0").cast("int"), F.lit(0)), "filters_empty": (F.col("filters") == "").cast("int"),
            "query_words": space_words(F.col("query_text")), "location_items": F.coalesce("_n", F.lit(0)),
        }
    ).drop("_words", "title_set", "params_set", "_clat", "_clon", "_n")


def attach_labels(frame: DataFrame, contexts: DataFrame) -> DataFrame:
    """label 1 for a query's chosen items among the candidates, else 0."""
    chosen = contexts.select("query_id", F.explode("item_ids").alias("doc_id")).distinct().withColumn("label", F.lit(1))
    return frame.join(chosen, ["query_id", "doc_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def with_positive(frame: DataFrame) -> DataFrame:
    """Rows of the queries that have a positive candidate."""
    return frame.join(frame.where("label > 0").select("query_id").distinct(), "query_id", "left_semi")


def check_contract(frame: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """The frame's keys and features in the contract's order, and ``keep``; a missing or repeated feature raises."""
    missing = [f for f in features if f not in frame.columns]
    if missing or len(set(features)) != len(features):
        raise ValueError(f"feature contract broken: missing {missing}, {len(features) - len(set(features))} repeated")
    return frame.select("query_id", "doc_id", *features, *(c for c in keep or [] if c not in features))
