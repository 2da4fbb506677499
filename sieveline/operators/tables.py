"""Small table operators: unique joins, row numbers, fixed samples, stage timings."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import stable_hash


def join_unique(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join whose right side must have each key once; raises otherwise."""
    repeated = right.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"keys are not unique: {[tuple(r[k] for k in keys) for r in repeated]}")
    return left.join(right, keys, "left")


def row_index(df: DataFrame, order: list[Column | str], name: str, path: str) -> DataFrame:
    """Position of each row, from 0, in a total order.

    Rows are sorted by range in parallel and written at ``path`` with their range and place in it, so
    that a lost executor can't deal them out anew; only the sizes of the ranges go through one task.
    """
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    ranged.withColumn("_local", local).write.mode("overwrite").parquet(path)
    placed = df.sparkSession.read.parquet(path)
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", before.alias("_start"))  # one row for each partition
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_local")).drop("_p", "_start", "_local")


def sample_rows(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows by least hash of their key: the same rows in any order and partitioning."""
    return df.withColumn("_h", stable_hash(F.col(key), seed)).orderBy("_h", key).limit(n).drop("_h")


class Timings(dict):
    """Seconds of named stages."""

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self[name] = self.get(name, 0.0) + time.perf_counter() - began


def peak_rss_gb() -> float:
    """The most memory that this process has held."""
    import resource
    import sys

    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (2**30 if sys.platform == "darwin" else 2**20)


def git_state(folder: str) -> dict[str, object]:
    """The commit of a checkout and whether it has changes; nulls where there is none."""
    import subprocess

    def git(*args: str) -> str | None:
        try:
            got = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=30)
        except OSError:
            return None
        return got.stdout.strip() if got.returncode == 0 else None

    status = git("status", "--porcelain")
    return {"commit": git("rev-parse", "HEAD"), "changed": None if status is None else bool(status)}
