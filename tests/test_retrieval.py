"""Lists, fusion, places and dense search on small frames."""

import re

import pytest
from pyspark.sql import functions as F

from sieveline.operators import dense, features, fusion, geo, lexical


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double")


def _order(df, by="rank"):
    out = {}
    for r in df.orderBy("query_id", by).collect():
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


def test_order_and_fusion(spark):
    assert _order(fusion.order_hits(_hits(spark, [(0, 5, 0.5), (0, 2, 0.9), (0, 9, 0.5)]))) == {0: [2, 5, 9]}
    run = lambda ids: spark.createDataFrame([(0, i, k + 1, 1.0) for k, i in enumerate(ids)], "query_id long, doc_id long, rank int, score double")
    assert _order(fusion.rrf_fuse([run([10, 20]), run([20, 30])])) == {0: [20, 10, 30]}
    assert _order(fusion.rrf_fuse([run([7]), run([3])])) == {0: [3, 7]}
    with pytest.raises(ValueError, match="different"):
        fusion.rrf_fuse([run([1]), run([])])


def test_pool(spark):
    make = lambda ids: spark.createDataFrame([(0, i, k + 1, 1.0 / (k + 1)) for k, i in enumerate(ids)], "query_id long, doc_id long, rank int, score double")
    pool = fusion.candidate_pool({"a": (make([0, 1, 2]), 3), "b": (make([1, 9, 8]), 1), "c": (make([5, 1]), 0)}, names=["a", "b", "c", "d"])
    rows = {r["doc_id"]: r for r in pool.collect()}
    assert _order(pool, "rrf_rank") == {0: [1, 0, 2]}
    assert (rows[1]["n_lists"], rows[0]["n_lists"], rows[1]["rank_d"], rows[0]["rank_c"]) == (2, 1, None, None)
    assert rows[1]["rrf"] == pytest.approx(1 / 62 + 1 / 61)
    queries = spark.createDataFrame([(0,), (1,)], "query_id long")
    assert {r["query_id"]: r["doc_ids"] for r in fusion.pool_rows(pool, queries).collect()} == {0: [1, 0, 2], 1: []}
    assert fusion.pool_size_stats(pool).first().asDict() == {"queries": 1, "mean_size": 3.0, "p95_size": 3.0}


def test_geo_rerank(spark):
    hits = spark.createDataFrame([(0, 0, 10.0, 7), (0, 1, 9.0, 5), (0, 2, 8.0, 5)], "query_id long, doc_id long, score double, loc int")
    by_weight = fusion.geo_rerank(hits, F.lit(5), F.col("loc"), 0.6)
    assert _order(by_weight) == {0: [1, 2, 0]} and by_weight.where("doc_id = 0").first()["score"] == pytest.approx(6.0)
    assert _order(fusion.geo_rerank(hits, F.lit(5), F.col("loc"), 1.0, 1.5)) == {0: [1, 0, 2]}


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_bm25_needs_stems_for_local_search(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "MOST_ASKED", most)  # what is asked is broadcast, or meets the parts of the documents
    docs = spark.createDataFrame([(0, "баня на дровах", 7), (1, "ремонт телефонов", 7), (2, "ремонт холодильников ремонт холодильников", 7), (3, "ремонт холодильников", 9)], "doc_id long, text string, loc int")
    queries = spark.createDataFrame([(0, "ремонт холодильника", 7), (1, "", 7)], "query_id long, text string, place int")
    idx = lexical.index(docs, config=lexical.BM25Config(stem=True))
    assert _order(lexical.search_local(idx, queries, 5, "place", docs)) == {0: [2, 1]}
    # without stems the query's second word is in no document
    assert lexical.scores(lexical.index(docs), queries).agg({"score": "max"}).first()[0] < lexical.scores(idx, queries).agg({"score": "max"}).first()[0]
    pairs = spark.createDataFrame([(0, 0), (0, 2), (1, 2)], "query_id long, doc_id long")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.pair_scores(idx, queries, pairs).collect()}
    assert got[0, 0] == got[1, 2] == 0.0 < got[0, 2]
    allowed = spark.createDataFrame([(0, 1)], "query_id long, doc_id long")
    assert _order(lexical.search_groups(idx, queries, 5, allowed)) == {0: [1]}


@pytest.mark.parametrize(("most", "hits"), [(1 << 18, 1 << 20), (4, 5)])
def test_a_search_shuffles_no_pairs(spark, monkeypatch, most, hits):
    monkeypatch.setattr(lexical, "MOST_ASKED", most)  # blocks of what is asked, and pieces of a task's documents
    monkeypatch.setattr(lexical, "MOST_HITS", hits)
    word = lambda a, b: F.element_at(F.array(*map(F.lit, ["ремонт", "баня", "и", "окна", "дверей"])), ((F.col("id") * a + b) % 5 + 1).cast("int"))
    docs = spark.range(60).repartition(3).select((100 - F.col("id")).alias("doc_id"), F.concat_ws(" ", word(1, 0), word(3, 1), word(7, 2), F.when(F.col("id") % 6 == 0, "окно")).alias("text"))
    docs = docs.union(spark.createDataFrame([(7, "ремонт"), (7, "ремонт бани"), (8, None)], "doc_id long, text string"))
    queries = spark.range(12).select(F.col("id").alias("query_id"), F.concat_ws(" ", word(2, 1), word(4, 0)).alias("text")).union(spark.createDataFrame([(77, "и"), (78, ""), (79, "нигде")], "query_id long, text string"))
    idx = lexical.index(docs, config=lexical.BM25Config(stem=True, stop_words=True))
    got = lexical.search(idx, queries, 4)
    rows = lambda df: [(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.orderBy("query_id", "rank").collect()]
    assert rows(got) == rows(lexical.top_k(lexical.scores(idx, queries), 4)) != []
    assert got.groupBy("query_id", "doc_id").count().where("count > 1").isEmpty() and got.columns == ["query_id", "doc_id", "score", "rank"]
    for found, pairs in ((got, False), (lexical.top_k(lexical.scores(idx, queries), 4), True)):
        assert bool(re.search(r"Aggregate \[query_id#\d+L?, doc_id", found._jdf.queryExecution().optimizedPlan().toString())) == pairs
    assert rows(lexical.search(idx, queries.where("query_id >= 77"), 4)) == rows(lexical.search(idx, queries.where("query_id < 0"), 4)) == []


@pytest.mark.parametrize(("most", "hits"), [(1 << 18, 1 << 20), (3, 4)])
def test_field_scores_within_a_place_shuffle_no_pairs(spark, monkeypatch, most, hits):
    monkeypatch.setattr(lexical, "MOST_ASKED", most)
    monkeypatch.setattr(lexical, "MOST_HITS", hits)
    rows = [(1, "стол дуб", "дуб светлый", 7), (2, "стул", None, 7), (3, "стол стол", "сосна", 9), (4, "шкаф", "дуб", None), (5, None, "дуб", 5), (3, "шкаф", "дуб", 9), (6, "", "сосна дуб", 7)]
    items = spark.createDataFrame(rows, "item_id long, title string, params string, loc int").repartition(3)
    rows = [(10, "стол", "дуб", 7), (11, "стул стол стол", "", 7), (12, "стол", None, 9), (13, "дуб", "дуб", None), (14, "", "", 7), (15, "нет", "дуб", 3), (16, "стол", "сосна", 7)]
    queries = spark.createDataFrame(rows, "query_id long, text string, filters string, loc int")
    fields, asked = {"bm25_title": "title", "bm25_params": "params"}, {"bm25_filters": ("filters", "params")}
    pairs = queries.select("query_id", "loc").join(items.select(F.col("item_id").alias("doc_id"), "loc"), "loc").select("query_id", "doc_id")
    got, want = lexical.field_scores_within(items, queries, "loc", fields, asked=asked, digits=6), lexical.field_scores(items, queries, pairs, fields, asked=asked)
    shown = lambda df: sorted((r["query_id"], r["doc_id"], *(round(r[c], 6) for c in (*fields, *asked))) for r in df.collect())
    assert shown(got) == shown(want) and got.columns == want.columns and got.count() == 14
    for df, shuffled in ((got, False), (want, True)):
        assert bool(re.search(r"Aggregate \[query_id#\d+L?, doc_id", df._jdf.queryExecution().optimizedPlan().toString())) == shuffled
    assert shown(lexical.field_scores_within(items, queries.where("loc = 3"), "loc", fields, asked=asked)) == shown(lexical.field_scores_within(items, queries.where("loc is null"), "loc", fields, asked=asked)) == []


def test_dense_search(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0], 7), (1, [0.8, 0.6], 5), (2, [0.0, 1.0], 7), (3, [0.6, 0.8], 5), (4, None, 5)], "doc_id long, embedding array<double>, loc int")
    queries = spark.createDataFrame([(0, [1.0, 0.0], 5), (1, [0.0, 1.0], 5), (2, [1.0, 1.0], 99), (3, None, 5)], "query_id long, embedding array<double>, loc int")
    assert _order(dense.search(docs.repartition(3), queries.where("query_id < 2"), 2)) == {0: [0, 1], 1: [2, 3]}
    assert _order(dense.search(docs, queries, 2, group="loc")) == {0: [1, 3], 1: [3, 1]}
    pairs = spark.createDataFrame([(0, 1), (0, 4)], "query_id long, doc_id long")
    assert [r["dense_sim"] for r in dense.pair_similarity(pairs, queries, docs).orderBy("doc_id").collect()] == [pytest.approx(0.8), None]


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    queries = spark.range(9).select(F.col("id").alias("query_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    rows = lambda: sorted(map(tuple, dense.search(docs, queries, 4).withColumn("score", F.round("score", 9)).collect()))
    whole = rows()
    monkeypatch.setattr(dense, "BLOCK", 2)
    assert rows() == whole
    monkeypatch.setattr(dense, "ROWS", 3)
    assert rows() == whole


def test_radius_join_equals_brute_force(spark):
    from sieveline.functions.numeric import haversine_km

    items = spark.range(900).select(F.col("id").alias("doc_id"), (F.pmod(F.col("id") * 37, F.lit(180)) - 90.0 + F.col("id") / 1000.0).alias("lat"), (F.pmod(F.col("id") * 91, F.lit(360)) - 180.0).alias("lon"))
    items = items.withColumn("lat", F.least("lat", F.lit(90.0)))
    centers = items.where("doc_id % 30 = 0").select(F.col("doc_id").alias("center_id"), "lat", "lon")
    for km in (25.0, 400.0, 3000.0):
        near = {(r["center_id"], r["doc_id"]) for r in geo.radius_join(centers, items, km).collect()}
        c = centers.withColumnsRenamed({"lat": "a", "lon": "b"})
        brute = {(r["center_id"], r["doc_id"]) for r in c.crossJoin(items).where(haversine_km(F.col("a"), F.col("b"), F.col("lat"), F.col("lon")) <= km).collect()}
        assert near == brute


def test_radius_join_skips_unknown_places(spark):
    centers = spark.createDataFrame([(0, 55.0, 37.0), (1, float("nan"), 37.0), (2, 55.0, 37.0), (3, 56.0, 37.0), (4, None, None)], "center_id long, lat double, lon double")
    items = spark.createDataFrame([(0, 55.0, 37.0), (1, 55.1, 37.0), (2, 56.0, 37.0), (3, float("nan"), float("nan")), (4, None, 1.0)], "doc_id long, lat double, lon double")
    got = sorted((r["center_id"], r["doc_id"]) for r in geo.radius_join(centers, items, 20.0).collect())
    assert got == [(0, 0), (0, 1), (2, 0), (2, 1), (3, 2)]
    plan = geo.radius_join(centers, items, 20.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _items(spark):
    rows = [("a", "Ремонт холодильников", "Вид услуги Ремонт", "114", "1", 100.0, 7, 55.0, 37.0), ("b", "Баня на дровах", "", "114", "2", -1.0, 7, 55.0, 37.0), ("c", None, None, "5", "3", None, 9, 56.0, 37.0)]
    return spark.createDataFrame(rows, "item_id string, title string, params string, category string, microcat string, price double, loc int, lat double, lon double")


def test_features(spark):
    items = _items(spark)
    queries = spark.createDataFrame([("q0", "ремонт холодильников", 7, "", "114"), ("q1", "баня", 100, "x", "0"), ("q2", "", None, "", None)], "query_id string, query_text string, search_loc int, filters string, category string")
    pool = queries.select("query_id").crossJoin(items.select(F.col("item_id").alias("doc_id"))).withColumns({"rrf": F.lit(0.1), "rrf_rank": F.lit(1), "n_lists": F.lit(1)})
    got = {(r["query_id"], r["doc_id"]): r for r in features.build_features(pool, queries, items, geo.location_stats(items)).collect()}
    a = got["q0", "a"]
    assert (a["title_overlap"], a["params_overlap"], a["loc_match"], a["cat_match"], a["dist_km"], a["location_items"]) == (1.0, 0.5, 1, 1, 0.0, 2)
    b = got["q1", "b"]
    assert (b["dist_km"], b["location_items"], b["query_cat_zero"], b["filters_empty"], b["price"]) == (None, 0, 1, 0, -1.0)
    c = got["q2", "c"]
    assert (c["title_overlap"], c["loc_match"], c["cat_match"], c["title_chars"], c["query_words"]) == (0.0, None, None, 0, 1)
    contexts = spark.createDataFrame([("q0", ["a", "gone"])], "query_id string, item_ids array<string>")
    frame = features.build_features(pool, queries, items, geo.location_stats(items))
    labelled = features.attach_labels(frame, contexts)
    assert {(r["query_id"], r["doc_id"]) for r in labelled.where("label = 1").collect()} == {("q0", "a")}
    assert features.with_positive(labelled).select("query_id").distinct().count() == 1
    with pytest.raises(ValueError, match="contract"):
        features.check_contract(frame, ["nothing"])


def test_stop_words_and_the_filters_field(spark):
    docs = spark.createDataFrame([(0, "и баня и на дровах"), (1, "ремонт и ремонт")], "doc_id long, text string")
    config = lexical.BM25Config(stem=True, stop_words=True)
    idx = lexical.index(docs, config=config)
    assert {(r["doc_id"], r["term"], r["tf"], r["dl"]) for r in idx.tf.collect()} == {(0, "бан", 1, 2), (0, "дров", 1, 2), (1, "ремонт", 2, 2)}
    queries = spark.createDataFrame([(0, "и на"), (1, "дрова и")], "query_id long, text string")
    assert {(r["query_id"], r["doc_id"]) for r in lexical.scores(idx, queries).collect()} == {(1, 0)}
    listings = spark.createDataFrame([(1, "стол", "дуб светлый"), (2, "стул", "сосна")], "item_id long, title string, params string")
    asked = spark.createDataFrame([(7, "стол", "дуб"), (8, "", "")], "query_id long, text string, filters string")
    pairs = spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "query_id long, doc_id long")
    got = {(r["query_id"], r["doc_id"]): (r["bm25_title"] > 0, r["bm25_params"] > 0, r["bm25_filters"] > 0) for r in lexical.field_scores(listings, asked, pairs, {"bm25_title": "title", "bm25_params": "params"}, asked={"bm25_filters": ("filters", "params")}).collect()}
    assert got == {(7, 1): (True, False, True), (7, 2): (False, False, False), (8, 1): (False, False, False)}
