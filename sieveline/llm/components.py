"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import common


def _pointed(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """For each u the least of itself and its neighbours (m) with its number of edges (n), and all edges with their u's m."""
    least = edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
    return least, common.keyed_join(edges, least, ["u"], total)


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id and class_id (the least id it is linked with, directly or not) of each id in ``links`` (a, b).

    ``known`` is an earlier result to go on from. Each round points every id at the least id among
    its neighbours and itself, first for larger neighbours, then for smaller ones; the number of
    rounds grows with the logarithm of the component's size. Least ids come from partial
    aggregates, and a hub's edges meet its least id by a broadcast of the few hubs, so no task gets
    all edges of an id; rounds end when the edges' number and checksum stay.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    if known is not None:
        edges = edges.unionByName(known.select(F.col("id").alias("u"), F.col("class_id").alias("v")).where("u <> v"))
    edges, before = common.table(edges, "edges"), None
    total = edges.count()
    while True:
        # large star: link each larger neighbour to the least of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = common.table(_pointed(both, 2 * total)[1].where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        # small star: link each smaller neighbour, and the id itself, to the least of them
        low, pointed = _pointed(large, total)
        small = pointed.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = common.table(small, "edges")
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        common.drop_tables(edges, large)
        edges, total = after, state[0]
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct())
