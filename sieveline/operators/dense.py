"""Exact inner-product top-k in Arrow batches.

Queries are taken in blocks of bounded size, each broadcast to a scan of the items: every task
keeps the k best of each query among its rows, so what is shuffled to the final cut is at most
k rows for each query and task. A task scores ``ROWS`` items at a time and looks closer only at those
that may be among a query's k best, so its memory is bounded by block, k and ``ROWS``. Ties are cut
by id in both phases, so both agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.numeric import dot
from sieveline.operators.lexical import top_k

#: Queries held by each worker at once, and items that it scores at once.
BLOCK, ROWS = 2048, 1024
DIGITS = 9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


class _Best:
    """The k best (score, id) of each query so far; ids are numbered by a growing list."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.at, self.ids = k, np.full((n, 0), -np.inf), np.zeros((n, 0), np.int64), np.zeros(0, object)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in a slice of items, of which a query keeps k at most."""
        scores = np.round(scores, DIGITS)
        if scores.shape[1] > self.k:
            # what is below a query's k-th best score of the slice can't be in; ties with it stay for the cut by id
            low = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k, None]
            scores = np.where(scores >= low, scores, -np.inf)
        every, known = np.concatenate([self.ids, ids]), len(self.ids)
        order = np.argsort(every, kind="stable")
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        both, at = np.concatenate([self.scores, scores], axis=1), np.concatenate([place[self.at], np.broadcast_to(place[known:], scores.shape)], axis=1)
        best = np.lexsort((at, -both), axis=1)[:, : self.k]
        self.scores, at = np.take_along_axis(both, best, 1), np.take_along_axis(at, best, 1)
        # forget ids that no query holds any more
        used, back = np.unique(np.where(np.isfinite(self.scores), at, order.size), return_inverse=True)
        real = used < order.size
        self.ids = np.concatenate([every[order[used[real]]], np.zeros(0, every.dtype)]) if real.any() else every[:0]
        self.at = np.minimum(back.reshape(at.shape), max(len(self.ids) - 1, 0))


def _search_block(items: DataFrame, ids: np.ndarray, vectors: np.ndarray, groups: np.ndarray | None, k: int, schema: str) -> DataFrame:
    held = items.sparkSession.sparkContext.broadcast((ids, vectors, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, q_group = held.value
        best = _Best(len(q_ids), k)
        for whole in batches:
            for start in range(0, whole.num_rows if len(q_ids) else 0, ROWS):
                batch = whole.slice(start, ROWS)
                scores = q @ _matrix(batch.column("embedding"), q.shape[1]).T
                if q_group is not None:
                    scores = np.where(q_group[:, None] == batch.column("grp").to_numpy(zero_copy_only=False)[None, :], scores, -np.inf)
                best.add(scores, batch.column("doc_id").to_numpy(zero_copy_only=False))
        keep = np.isfinite(best.scores)
        if keep.any():
            rows = np.broadcast_to(q_ids[:, None], keep.shape)
            yield pa.RecordBatch.from_arrays([pa.array(rows[keep]), pa.array(best.ids[best.at[keep]]), pa.array(best.scores[keep])], names=["query_id", "doc_id", "score"])

    return items.mapInArrow(run, schema)


def search(items: DataFrame, queries: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """The k best ``items`` (doc_id, embedding) for each of ``queries`` (query_id, embedding), with rank.

    With ``group`` (a column of both) only items of the query's own group compete. Scores are rounded to
    ``DIGITS`` digits. The driver holds a block of queries at a time.
    """
    cols = ["embedding"] + ([F.col(group).alias("grp")] if group else [])
    items = items.select("doc_id", *cols).where("embedding is not null")
    queries = queries.select("query_id", *cols).where("embedding is not null")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {items.schema['doc_id'].dataType.simpleString()}, score double"
    blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for b in range(blocks):
        got = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        if not got.num_rows and (found is not None or b < blocks - 1):
            continue  # an empty block, but one is kept for the schema
        vectors = np.array(got["embedding"].to_pylist(), np.float64).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, 0))
        part = _search_block(items, got["query_id"].to_numpy(), vectors, got["grp"].to_numpy() if group else None, k, schema)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, digits=DIGITS)


def pair_similarity(pairs: DataFrame, queries: DataFrame, items: DataFrame, name: str = "dense_sim") -> DataFrame:
    """Inner product of each given (query_id, doc_id); null where a vector is missing."""
    q = queries.select("query_id", F.col("embedding").alias("_q"))
    d = items.select("doc_id", F.col("embedding").alias("_d"))
    return pairs.join(q, "query_id", "left").join(d, "doc_id", "left").withColumn(name, dot(F.col("_q"), F.col("_d"))).drop("_q", "_d")
