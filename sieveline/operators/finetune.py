"""Training triples for an encoder: hard negatives from ranked lists, batches without repeats."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import SEPARATOR, stable_hash

LOW, HIGH, PER_TEXT = 10, 100, 4


def few_per_text(contexts: DataFrame, n: int = PER_TEXT, seed: str = "42") -> DataFrame:
    """At most n contexts of each text, by least hash of their id."""
    order = Window.partitionBy("query_text").orderBy(stable_hash(F.col("query_id"), seed), "query_id")
    return contexts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn")


def pick_triples(hits: DataFrame, contexts: DataFrame, low: int = LOW, high: int = HIGH, seed: str = "42") -> DataFrame:
    """query_id, a chosen item and a negative: one of each by least hash.

    Negatives have ranks from ``low`` (counted from 0) up to ``high`` and were never chosen for the same text.
    """
    order = lambda c: stable_hash(F.concat_ws(SEPARATOR, F.col("query_id").cast("string"), F.col(c).cast("string")), seed)
    first = lambda c: F.min(F.struct(order(c).alias("h"), F.col(c).alias("v")))["v"]
    chosen = contexts.select("query_id", "query_text", F.explode("item_ids").alias("pos"))
    known = chosen.select("query_text", F.col("pos").alias("neg")).distinct()
    band = hits.where((F.col("rank") > low) & (F.col("rank") <= high)).select("query_id", F.col("doc_id").alias("neg")).join(contexts.select("query_id", "query_text"), "query_id")
    negative = band.join(known, ["query_text", "neg"], "left_anti").groupBy("query_id").agg(first("neg").alias("neg"))
    return chosen.groupBy("query_id").agg(first("pos").alias("pos")).join(negative, "query_id")


def unique_batches(rows: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    """Batches of (text, positive, negative) in which no text or item occurs twice; an incomplete last one is dropped.

    Rows that clash wait for a later batch, so this runs over a sample on the driver.
    """
    waiting = list(rows)
    while waiting:
        batch, rest, used = [], [], set()
        for row in waiting:
            keys = {("t", row[0]), ("i", row[1]), ("i", row[2])}
            if len(batch) < size and len(keys) == 3 and not keys & used:
                batch.append(row)
                used |= keys
            else:
                rest.append(row)
        if len(batch) < size:
            return
        yield batch
        waiting = rest
