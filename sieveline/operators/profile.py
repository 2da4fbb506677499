"""Profiles of tables: each is one aggregate pass over the columns it needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators import tables
from sieveline.sources import io

# Quantiles of a profile.
LEVELS = [0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def distribution(df: DataFrame, column: str, name: str) -> DataFrame:
    """Counts and percentages of a column's values, most frequent first (ties by value)."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(F.lit(name).alias("dataset"), "value", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))  # one row


def top_values(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    return distribution(df, column, name).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)


def quantiles(df: DataFrame, column: str, name: str, levels: list[float] = LEVELS) -> DataFrame:
    """Non-null count, extremes and exact interpolated quantiles, from the places of the sorted values: no task holds all of them."""
    spark = df.sparkSession
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    placed = tables.row_index(x, ["x"], "row", io.scratch(spark, "sorted"))
    n = placed.count()
    cells = []
    for p in levels:
        at = p * max(n - 1, 0)
        low, high = (F.max(F.when(F.col("row") == k, F.col("x"))) for k in (int(at), min(int(at) + 1, max(n - 1, 0))))
        cells.append((low + (high - low) * (at - int(at))).alias(f"p{int(100 * p):02d}"))
    one = placed.agg(F.count("*").alias("n"), F.min("x").alias("min"), *cells, F.max("x").alias("max"))
    return one.select(F.lit(name).alias("dataset"), F.lit(column).alias("column"), "*")


def _distinct(*columns: Column) -> Column:
    """Number of distinct values, told apart by two 64-bit hashes, so that values aren't shuffled."""
    return F.countDistinct(F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))


def integrity(df: DataFrame, key: str, pattern: str, name: str) -> DataFrame:
    """Rows, repeated whole rows, null, malformed and distinct keys."""
    text = F.col(key).cast("string")
    rows = _distinct(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns))
    return df.agg(F.count("*").alias("n_rows"), (F.count("*") - rows).alias("duplicate_rows"), F.count_if(text.isNull()).alias("null_ids"), F.count_if(~text.rlike(pattern)).alias("malformed_ids"), F.countDistinct(text).alias("unique_ids")).select(F.lit(name).alias("dataset"), "*")


def missingness(df: DataFrame, name: str) -> DataFrame:
    """Percentage of null and of blank values of each column, in one pass."""
    cells = [F.struct(F.lit(c).alias("column"), (100.0 * F.count_if(F.col(c).isNull()) / F.count("*")).alias("null_percent"), (100.0 * F.count_if(F.trim(F.col(c).cast("string")) == "") / F.count("*")).alias("blank_percent")) for c in df.columns]
    return df.agg(F.array(*cells).alias("a")).select(F.lit(name).alias("dataset"), F.inline("a"))


def conflicts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each column how many keys have several values (null is a value)."""
    n = [(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]
    per_key = df.groupBy(key).agg(*n)
    return per_key.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c) > 1).alias("conflicting_keys")) for c in columns)).alias("a")).select(F.inline("a"))


def checks(df: DataFrame, conditions: dict[str, Column], name: str) -> DataFrame:
    """Count and percentage of the rows that meet each condition."""
    cells = [F.struct(F.lit(c).alias("check"), F.count_if(x).alias("n"), (100.0 * F.count_if(x) / F.count("*")).alias("percent")) for c, x in conditions.items()]
    return df.agg(F.array(*cells).alias("a")).select(F.lit(name).alias("dataset"), F.inline("a"))


def bucket_shares(df: DataFrame, buckets: dict[str, Column], name: str) -> DataFrame:
    return checks(df, buckets, name).withColumnRenamed("check", "bucket")


def anomalies() -> dict[str, Column]:
    """Conditions that an item's numbers shouldn't meet."""
    # The checks' names and limits.
    p, r, n, lat, lon = (F.col(c) for c in ("item_price", "item_rating", "item_rating_reviews_count", "item_latitude", "item_longitude"))
    return {
        "price_negative": p < 0, "price_zero": p == 0, "price_one": p == 1, "price_over_1_million": p > 1_000_000, "rating_outside_0_5": ~r.between(0, 5), "reviews_negative": n < 0, "reviews_fractional": n != F.floor(n),
        "latitude_outside_90": F.abs(lat) > 90, "longitude_outside_180": F.abs(lon) > 180, "zero_coordinates": (lat == 0) & (lon == 0), "both_contacts_disabled": F.col("item_is_phone_hidden").cast("boolean") & F.col("item_is_message_forbidden").cast("boolean"),
    }


def price_buckets(p: Column) -> dict[str, Column]:
    return {"-1": p == -1, "0": p == 0, "1": p == 1, "2-1000": (p > 1) & (p <= 1000), "1001-10000": (p > 1000) & (p <= 10_000), ">10000": p > 10_000}


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, log: bool = False) -> DataFrame:
    """Rows in each of ``bins`` equal bins from low (included) to high (excluded), on a logarithmic axis if asked."""
    x = F.col(column).cast("double")
    x = F.when(x > 0, F.log10(x)) if log else x
    k = F.floor((x - low) / ((high - low) / bins))
    return df.select(k.alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count("*").alias("n"))


def text_profile(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """Mean length, texts shared by several keys, markup and texts over 2000 characters."""
    t = F.coalesce(text, F.lit(""))
    return df.agg(F.count("*").alias("n"), F.avg(F.length(t)).alias("mean_chars"), (F.countDistinct(key) - _distinct(t)).alias("extra_keys"), F.count_if(t.rlike("<[a-zA-Z/][^>]*>")).alias("with_markup"), F.count_if(F.length(t) > 2000).alias("over_2000")).select(F.lit(name).alias("dataset"), "*")


def popularity(pairs: DataFrame) -> DataFrame:
    """For each text its rows, distinct items and places."""
    return pairs.groupBy("query_text").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"), F.countDistinct("search_loc").alias("n_places"))


def popularity_mass(pairs: DataFrame, n: int = 100) -> DataFrame:
    """Percentage of rows of the n most frequent texts, and texts searched in several places."""
    per_text = popularity(pairs)
    top = per_text.orderBy(F.desc("n"), "query_text").limit(n).agg(F.sum("n").alias("top"))
    return per_text.agg(F.count("*").alias("texts"), F.sum("n").alias("n_rows"), F.count_if(F.col("n_places") > 1).alias("multi_place")).join(F.broadcast(top)).select("texts", "n_rows", "multi_place", (100.0 * F.col("top") / F.col("n_rows")).alias("top_percent"))  # one row


def supply(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, name: str) -> DataFrame:
    """How many items each query could choose from: none, under 50, median and extremes."""
    n = items.groupBy(F.col(item_key).alias("_k")).agg(F.count("*").alias("n"))
    got = queries.join(n, F.col(query_key) == F.col("_k"), "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return got.agg(F.count_if(F.col("n") == 0).alias("none"), F.count_if(F.col("n") < 50).alias("under_50"), F.median("n").alias("median"), F.min("n").alias("min"), F.max("n").alias("max")).select(F.lit(name).alias("scope"), "*")


def ceilings(contexts: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Best possible mean recall at k when all, the same place's or the same category's items are allowed."""
    chosen = contexts.select("query_id", "search_loc", F.col("category").alias("q_category"), F.explode("item_ids").alias("item_id")).join(items.select("item_id", "loc", F.col("category").alias("i_category")), "item_id", "left")
    per = chosen.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("search_loc") == F.col("loc")).alias("n_loc"), F.count_if(F.col("q_category") == F.col("i_category")).alias("n_cat"))
    best = lambda c: F.avg(F.least(F.lit(k), F.col(c)) / F.col("n"))
    return per.agg(best("n").alias("unfiltered"), best("n_loc").alias("same_location"), best("n_cat").alias("same_category"))


def match_rates(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Percentage of rows, and of distinct pairs, whose item is in the searched place; unknown counts as not."""
    same = F.coalesce(F.col("search_loc") == F.col("loc"), F.lit(False)).cast("double")
    places = items.select("item_id", "loc")
    unique = pairs.select("query_text", "search_loc", "item_id").distinct()
    return reduce(DataFrame.unionByName, (df.join(places, "item_id", "left").agg(F.lit(name).alias("unit"), F.count("*").alias("n"), (100 * F.avg(same)).alias("same_place_percent")) for name, df in (("rows", pairs), ("unique_pairs", unique))))


def overlap_counts(queries: DataFrame, train: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """For each named key list how many distinct keys of ``queries`` also occur in ``train``; nulls are equal."""
    parts = []
    for name, cols in keys.items():
        own, other = queries.select(*cols).distinct(), train.select(*(F.col(c).alias(f"_{c}") for c in cols)).distinct()
        match = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols))
        parts.append(own.join(other, match, "left_semi").agg(F.lit(name).alias("key"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def lexical_coverage(pairs: DataFrame, query_tokens: Column, fields: dict[str, Column]) -> DataFrame:
    """Mean share of a query's tokens in growing sets of fields, and percentages without any and with all."""
    share = lambda t: F.when(F.size(query_tokens) > 0, F.size(F.array_intersect(query_tokens, t)) / F.size(query_tokens))
    got = pairs.select(*(share(t).alias(n) for n, t in fields.items()))
    cells = [F.struct(F.lit(n).alias("fields"), F.avg(n).alias("mean_share"), (100 * F.avg((F.col(n) == 0).cast("double"))).alias("zero_percent"), (100 * F.avg((F.col(n) == 1).cast("double"))).alias("all_percent")) for n in fields]
    return got.agg(F.array(*cells).alias("a")).select(F.inline("a"))


def case_examples(df: DataFrame, cases: dict[str, Column], columns: list[str], n: int = 5) -> DataFrame:
    """The first n distinct rows of each case in the order of ``columns``."""
    tagged = df.select(*columns, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in cases.items())))).alias("case")).distinct()
    order = Window.partitionBy("case").orderBy(*columns)
    return tagged.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
