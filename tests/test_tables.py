"""Unique joins, row numbers, samples, timings and the recall curve."""

import pytest
from pyspark.sql import functions as F

from sieveline.operators import ranker, tables


def test_join_unique(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x")], "k int, w string")
    assert sorted((r["k"], r["w"]) for r in tables.join_unique(left, right, ["k"]).collect()) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError, match="not unique"):
        tables.join_unique(left, right.unionByName(right), ["k"])


def test_row_index_and_sample(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"), F.concat(F.lit("k"), "id").alias("key"))
    got = {r["v"]: r["row"] for r in tables.row_index(df.repartition(7), ["v"], "row", str(tmp_path / "r")).collect()}
    assert got == {k: k for k in range(500)}
    pick = lambda d: {r["key"] for r in tables.sample_rows(d, "key", 20).collect()}
    assert pick(df) == pick(df.repartition(9)) and len(pick(df)) == 20


def test_recall_curve_counts_misses_and_empty_pools(spark):
    rows = [("q2", k, float(k % 2), int(k % 2), k) for k in range(8)] + [("q5", k, 0.0, 0, k) for k in range(4)]
    frame = spark.createDataFrame(rows, "query_id string, doc_id long, f double, label int, rrf_rank int")
    queries = spark.createDataFrame([("q2", [1, 99]), ("q5", [98]), ("q8", [97])], "query_id string, item_ids array<long>")
    model = ranker.train_gbt(frame, ["f"], 2, 2)
    got = {r["trees"]: r["recall"] for r in ranker.recall_curve(model, frame, queries, ["f"], [1, 2], 4).collect()}
    assert got == {1: pytest.approx(1 / 6), 2: pytest.approx(1 / 6)}


def test_timings():
    t = tables.Timings()
    with t.stage("a"):
        pass
    with pytest.raises(RuntimeError), t.stage("b"):
        raise RuntimeError
    assert set(t) == {"a", "b"} and all(v >= 0 for v in t.values())


def test_telemetry(tmp_path):
    assert 0.01 < tables.peak_rss_gb() < 1000
    assert tables.git_state(str(tmp_path)) == {"commit": None, "changed": None}
