"""Places: medians of coordinates, centres with fallback, radius joins over a grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.numeric import haversine_km

KM_PER_DEGREE = 111.0


def location_stats(items: DataFrame) -> DataFrame:
    """Median coordinates and number of items of each place."""
    return items.groupBy("loc").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.count("*").alias("n_items"))


def location_centers(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each searched place (of each view, with ``keys``) the median of its chosen items' coordinates, pairs, items and median spread in km."""
    own = [*keys, "search_loc"]
    located = pairs.where("lat is not null and lon is not null")
    centre = located.groupBy(*own).agg(F.median("lat").alias("c_lat"), F.median("lon").alias("c_lon"), F.count("*").alias("n_pairs"), F.countDistinct("item_id").alias("n_items"))
    away = haversine_km(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon"))
    spread = located.join(centre, own).groupBy(*own).agg(F.median(away).alias("spread_km"))
    return centre.join(spread, own).withColumnsRenamed({"c_lat": "lat", "c_lon": "lon"})


def query_centers(places: DataFrame, stats: DataFrame, history: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Centre of each searched place: the corpus' own median, else the history's (of the same view); source 0, 1 or 2 (unknown)."""
    own = stats.select(F.col("loc").alias("search_loc"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    past = history.select(*keys, "search_loc", F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"))
    joined = places.select(*keys, "search_loc").distinct().join(own, "search_loc", "left").join(past, [*keys, "search_loc"], "left")
    source = F.when(F.col("o_lat").isNotNull(), 0).when(F.col("h_lat").isNotNull(), 1).otherwise(2)
    return joined.select(*keys, "search_loc", F.coalesce("o_lat", "h_lat").alias("lat"), F.coalesce("o_lon", "h_lon").alias("lon"), source.alias("center_source"))


def radius_join(centers: DataFrame, items: DataFrame, km: float) -> DataFrame:
    """Pairs (center_id, doc_id, dist_km) within ``km``; unknown centres and items pair with nothing.

    Items lie in grid cells of the radius' height; a centre is sent to the cells that its circle
    can touch, wider ones in longitude towards the poles, where it goes to the whole row. So
    the plan is an equi-join on cells with an exact filter, whatever the number of centres.
    """
    size = km / KM_PER_DEGREE * 1.01
    rows, columns = F.floor((F.col("lat") + 90) / size), math.ceil(360 / size)
    located = items.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").select(F.col("doc_id"), F.col("lat").alias("i_lat"), F.col("lon").alias("i_lon"), rows.alias("cy"), F.pmod(F.floor((F.col("lon") + 180) / size), F.lit(columns)).alias("cx"))
    known = centers.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").select("center_id", "lat", "lon")
    # the widest circle of longitude that the row above or below may need
    narrow = F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + size)))
    reach = F.least(F.lit(columns), F.ceil(F.lit(1.0) / F.greatest(narrow, F.lit(1e-6)))).cast("int")
    spread = known.withColumn("cy", F.explode(F.sequence(rows - 1, rows + 1)))
    wide = F.when(reach * 2 + 1 >= columns, F.sequence(F.lit(0), F.lit(columns - 1))).otherwise(F.transform(F.sequence(-reach, reach), lambda d: F.pmod(F.floor((F.col("lon") + 180) / size) + d, F.lit(columns)).cast("int")))
    spread = spread.withColumn("cx", F.explode(F.array_distinct(F.transform(wide, lambda x: x.cast("long")))))
    near = located.join(spread, ["cy", "cx"])
    dist = haversine_km(F.col("lat"), F.col("lon"), F.col("i_lat"), F.col("i_lon"))
    return near.withColumn("dist_km", dist).where(F.col("dist_km") <= km).select("center_id", "doc_id", "dist_km")
