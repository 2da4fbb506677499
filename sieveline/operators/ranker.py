"""Ranking: a fixed linear scorer, a boosted-tree scorer, the cut to the best, curves over tree prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K = 50
LINEAR = {"rrf": 30.0, "title_overlap": 1.0, "params_overlap": 0.25, "loc_match": 0.5}


def linear_score(weights: dict[str, float] = LINEAR) -> Column:
    """A weighted sum of features, nulls as 0."""
    return F.round(reduce(Column.__add__, (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w for f, w in weights.items())), 9)


def model_ranks(frame: DataFrame, score: str = "score") -> DataFrame:
    """model_rank: by score, equal scores by rrf_rank."""
    return frame.withColumn("model_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "rrf_rank")))


def select_top(frame: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Each query's k best ids in order; an empty list for a query without candidates."""
    best = model_ranks(frame).where(F.col("model_rank") <= k)
    own = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("model_rank", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    empty = F.array().cast(own.schema["doc_ids"].dataType)
    return queries.select("query_id").join(own, "query_id", "left").withColumn("doc_ids", F.coalesce("doc_ids", empty))


def train_gbt(frame: DataFrame, features: list[str], trees: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42):
    """Gradient-boosted trees on (features, label), nulls as -1; a pointwise stand-in for listwise boosting."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = _filled(frame, features).select("label", *features)
    stages = [VectorAssembler(inputCols=features, outputCol="_x"), GBTClassifier(labelCol="label", featuresCol="_x", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def _filled(frame: DataFrame, features: list[str]) -> DataFrame:
    return frame.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in features})


def predict_gbt(model, frame: DataFrame, features: list[str], trees: int | None = None) -> DataFrame:
    """Adds score, the margin after all trees or the first ``trees``."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_filled(frame, features))
    if trees is None:
        return scored.withColumn("score", F.round(vector_to_array("rawPrediction")[1], 9)).drop("_x", "rawPrediction", "probability", "prediction")
    gbt = model.stages[-1]
    assembled = model.stages[0].transform(_filled(frame, features))
    parts = []
    for k, (tree, weight) in enumerate(zip(gbt.trees[:trees], gbt.treeWeights[:trees], strict=True)):
        assembled = tree.setPredictionCol(f"_t{k}").transform(assembled)
        parts.append(F.col(f"_t{k}") * weight)
    return assembled.withColumn("score", F.round(reduce(Column.__add__, parts), 9)).drop("_x", *(f"_t{k}" for k in range(len(parts))))


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    found = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, found, strict=True), key=lambda x: (-x[1], x[0]))


def recall_curve(model, frame: DataFrame, queries: DataFrame, features: list[str], trees: list[int], k: int = TOP_K) -> DataFrame:
    """trees and mean recall at k over all of ``queries`` (query_id, item_ids), pool misses and empty pools included."""
    from sieveline.operators.evaluation import recall_at_k

    out = None
    for t in trees:
        best = select_top(predict_gbt(model, frame, features, t), queries, k)
        one = queries.join(best, "query_id").agg(F.lit(t).alias("trees"), F.avg(recall_at_k(F.col("doc_ids"), F.col("item_ids"), k)).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out
