"""History, microcategories, signals, ranking, metrics, diagnostics and answers on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import contrastive, diagnostics, evaluation, finetune, geo, history, microcats, profile, ranker, signals, submission
from sieveline.operators.encode import EncoderConfig
from sieveline.operators.lexical import BM25Config
from sieveline.plans.config import FeatureConfig, RetrievalConfig, SearchConfig, check_model, from_contract
from sieveline.streaming import history as stream

from .test_retrieval import _items


def _contexts(spark, rows):
    return spark.createDataFrame([(f"q{k}", t, p, i) for k, (t, p, i) in enumerate(rows)], "query_id string, query_text string, search_loc int, item_ids array<string>")


# Six listings on one meridian, a degree (111.19 km) or a tenth of one apart: town 1 has two, town 2
# three and town 3 one. Their microcategories are m1 and m2; the last has none.
TOWNS = [("p", 1, "m1", 10.0), ("q", 1, "m2", 10.2), ("r", 2, "m1", 20.0), ("s", 2, "m1", 20.1), ("t", 2, "m2", 23.0), ("u", 3, None, 40.0)]
DEGREE = 6371.0 * math.pi / 180


def _towns(spark):
    return spark.createDataFrame([(i, loc, m, lat, 50.0) for i, loc, m, lat in TOWNS], "item_id string, loc int, microcat string, lat double, lon double")


def test_centres_of_searched_places_come_from_what_was_chosen_there(spark):
    log = [("x", 8, ["r", "s"]), ("y", 8, ["t"]), ("z", 8, ["t"]), ("w", 9, ["u"]), ("v", 6, []), ("n", 6, None)]
    got = {r["search_loc"]: r for r in geo.location_centers(history.history_pairs(_contexts(spark, log), _towns(spark))).collect()}
    # of 20.0, 20.1, 23.0, 23.0 the median is 21.55, and of the distances from it 1.45, 1.45, 1.45, 1.55 the median is 1.45
    assert set(got) == {8, 9}
    assert (got[8]["n_pairs"], got[8]["n_items"], got[8]["lat"]) == (4, 3, pytest.approx(21.55)) and got[8]["spread_km"] == pytest.approx(1.45 * DEGREE, rel=1e-6)
    assert (got[9]["n_pairs"], got[9]["spread_km"]) == (1, 0.0)
    # with views, each has its own centres
    viewed = history.crossfit_pairs(history.history_pairs(_contexts(spark, log), _towns(spark)), spark.createDataFrame([], "query_text string"))
    per_view = geo.location_centers(viewed, ("view_id",))
    whole = {r["search_loc"]: r["lat"] for r in per_view.where("view_id = 5").collect()}
    assert whole == {8: pytest.approx(21.55), 9: 40.0}
    for v in range(5):
        seen = viewed.where(F.col("view_id") == v).drop("view_id")
        want = {r["search_loc"]: r["lat"] for r in geo.location_centers(seen).collect()}
        assert {r["search_loc"]: r["lat"] for r in per_view.where(F.col("view_id") == v).collect()} == want


def test_distance_falls_back_on_history_and_is_damped_where_that_is_thin(spark):
    items = _towns(spark)
    # place 8: five close choices (reliable); 9: one choice; 6: five choices 3 degrees apart (spread out); 5: none
    log = [(f"a{k}", 8, ["r"]) for k in range(5)] + [("b", 9, ["u"])] + [(f"c{k}", 6, ["r", "t"]) for k in range(3)]
    centers = geo.location_centers(history.history_pairs(_contexts(spark, log), items))
    frame = spark.createDataFrame([("near", 2, 20.1), ("steady", 8, 21.0), ("thin", 9, 41.0), ("wide", 6, 20.0), ("nowhere", 5, 20.0), ("blank", 2, None)], "query_id string, search_loc int, lat double").select("query_id", F.lit("d").alias("doc_id"), "search_loc", "lat", F.lit(50.0).alias("lon"))
    out = {r["query_id"]: r for r in history.geo_damping(history.geo_fallback(frame, geo.location_stats(items), centers)).collect()}
    source = {k: (r["center_source"], r["hist_pairs"], r["geo_unreliable"]) for k, r in out.items()}
    assert source == {"near": (0, 0, 0), "steady": (1, 5, 0), "thin": (1, 1, 1), "wide": (1, 6, 1), "nowhere": (2, 0, 0), "blank": (0, 0, 0)}
    # town 2's own median is 20.1
    assert out["near"]["dist_km"] == pytest.approx(0, abs=1e-6) and out["steady"]["dist_km"] == pytest.approx(DEGREE) and out["thin"]["dist_km"] == pytest.approx(DEGREE)
    assert out["nowhere"]["dist_km"] is None is out["blank"]["dist_km"]
    assert out["steady"]["log_dist_clean"] == pytest.approx(math.log(1 + DEGREE)) and (out["thin"]["log_dist_clean"], out["wide"]["log_dist_clean"], out["nowhere"]["log_dist_clean"]) == (-1, -1, None)
    far = frame.limit(1).withColumns({"query_id": F.lit("far"), "lat": F.lit(60.0)})
    assert history.geo_damping(history.geo_fallback(far, geo.location_stats(items), centers)).first()["log_dist_clean"] == pytest.approx(math.log(1001))
    with pytest.raises(ValueError, match="fallback"):
        history.geo_damping(frame)


def test_transitions_are_smoothed_by_the_corpus_share(spark):
    items = _towns(spark)
    share = history.corpus_location_share(items)
    assert {r["loc"]: r["share"] for r in share.collect()} == {1: pytest.approx(2 / 6), 2: pytest.approx(3 / 6), 3: pytest.approx(1 / 6)}
    # from place 1 five choices: four in town 2, one in town 3
    pairs = history.history_pairs(_contexts(spark, [("x", 1, ["r", "s"]), ("y", 1, ["t", "r", "u"])]), items)
    frame = spark.createDataFrame([(1, 2), (1, 1), (4, 2), (4, 9)], "search_loc int, item_loc int")
    counts, totals = history.transitions(pairs, share)
    got = {(r["search_loc"], r["item_loc"]): r for r in history.transition_features(frame, counts, totals, share, alpha=6.0).collect()}
    assert (got[1, 2]["trans_prob"], got[1, 1]["trans_prob"]) == (pytest.approx((4 + 3) / 11), pytest.approx((0 + 2) / 11))
    assert (got[1, 2]["trans_pairs"], got[1, 2]["trans_support"], got[1, 2]["trans_targets"], got[1, 2]["trans_unknown"], got[1, 1]["trans_unknown"]) == (4, 5, 2, 0, 1)
    assert got[1, 2]["trans_lift"] == pytest.approx(math.log(1 + (7 / 11) / (1 / 2))) and got[1, 2]["trans_outside_share"] == 0
    # a place without history falls back on the share; a town outside the corpus has no lift
    assert got[4, 2]["trans_prob"] == pytest.approx(1 / 2) and got[4, 2]["trans_lift"] == pytest.approx(math.log(2)) and got[4, 2]["trans_outside_share"] is None
    assert got[4, 9]["trans_prob"] == 0 and got[4, 9]["trans_lift"] is None
    small = history.transitions(pairs, share.where("loc <> 2"))[1].first()
    assert (small["support"], small["targets"], small["outside_share"]) == (1, 1, pytest.approx(4 / 5))


def test_neighbours_are_those_that_the_view_allows(spark):
    """Three past texts on the unit circle: a query meets the nearest of those its view may see."""
    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    texts = spark.createDataFrame([("east", at(0)), ("north", at(90)), ("between", at(40)), ("unseen", at(20))], "query_text string, embedding array<double>")
    pairs = spark.createDataFrame([(0, "east", "p", "m1"), (0, "north", "t", "m2"), (1, "north", "t", "m2"), (1, "between", "u", None), (0, "between", "u", None)], "view_id int, query_text string, item_id string, microcat string")
    queries = spark.createDataFrame([("a", 0, at(10)), ("b", 1, at(10)), ("c", 7, at(10))], "query_id string, view_id int, embedding array<double>")
    got = lambda **k: {q: [r["query_text"] for r in microcats.history_neighbors(texts, queries, pairs, **k).where(F.col("query_id") == q).orderBy(F.desc("score")).collect()] for q in "abc"}
    assert got() == {"a": ["east", "between", "north"], "b": ["between", "north"], "c": []}
    assert got(k=1) == {"a": ["east"], "b": ["between"], "c": []}
    # a text without a microcategory says nothing about microcategories
    assert got(need_microcat=True) == {"a": ["east", "north"], "b": ["north"], "c": []}
    near = microcats.history_neighbors(texts, queries, pairs, need_microcat=True)
    prob, _ = microcats.distribution(near, microcats.text_microcats(pairs, ("view_id",)), True, ("view_id",))
    found = {(r["query_id"], r["microcat"]): r["mc_prob"] for r in prob.collect()}
    gap = math.exp((math.cos(math.radians(80)) - math.cos(math.radians(10))) / 0.05)
    assert found == {("a", "m1"): pytest.approx(1 / (1 + gap), abs=1e-6), ("a", "m2"): pytest.approx(gap / (1 + gap), abs=1e-6), ("b", "m2"): 1.0}


def test_exact_prior_leaves_out_a_query_s_own_text(spark):
    """In a view that doesn't hold the text itself there is no exact match, whatever its labels are."""
    texts = spark.createDataFrame([("own", [1.0, 0.0]), ("other", [0.6, 0.8])], "query_text string, embedding array<double>")
    pairs = spark.createDataFrame([("own", 0, "m1"), ("other", 1, "m2")], "query_text string, fold int, microcat string")
    seen = history.crossfit_pairs(pairs, pairs.limit(0).select("query_text"), 2)
    queries = spark.createDataFrame([("held", 0, [1.0, 0.0]), ("full", 2, [1.0, 0.0])], "query_id string, view_id int, embedding array<double>")
    near = microcats.history_neighbors(texts, queries, seen)
    prob, per_query = microcats.distribution(near, microcats.text_microcats(seen, ("view_id",)), True, ("view_id",))
    assert {(r["query_id"], r["microcat"]): r["mc_prob"] for r in prob.collect() if r["mc_prob"] > 0} == {("held", "m2"): 1.0, ("full", "m1"): 1.0}
    assert {r["query_id"]: r["mc_is_exact_match"] for r in per_query.collect()} == {"held": 0, "full": 1}


def test_centroids_ignore_choices_outside_the_view(spark):
    items = spark.createDataFrame([("e", [1.0, 0.0]), ("n", [0.0, 1.0]), ("w", [-1.0, 0.0])], "item_id string, embedding array<double>")
    texts = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.8, 0.6])], "query_text string, embedding array<double>")
    pairs = lambda hidden: spark.createDataFrame([(0, "x", "e", "m"), (1, "x", "e", "m"), (1, "y", hidden, "m")], "view_id int, query_text string, item_id string, microcat string")
    queries = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [1.0, 0.0])], "query_id string, view_id int, embedding array<double>")

    def centroids(seen):
        near = microcats.history_neighbors(texts, queries, seen)
        return {r["query_id"]: r["embedding"] for r in signals.neighbor_centroids(near, signals.text_item_means(seen, items)).collect()}

    first, second = centroids(pairs("n")), centroids(pairs("w"))
    assert first["a"] == second["a"] == [1.0, 0.0]
    w = math.exp(-0.2 / 0.05)  # the second text's weight against the first's, at a similarity of 0.8
    assert first["b"] == pytest.approx([1 / math.hypot(1, w), w / math.hypot(1, w)]) and second["b"] == [1.0, 0.0]
    assert history.union_of_views(pairs("n")).count() == 2


def test_crossfit_never_shows_a_text_its_own_fold(spark):
    own = _contexts(spark, [(f"t{k}", 7, ["a"]) for k in range(60)] + [("held", 7, ["b"])])
    holdout = spark.createDataFrame([("held",)], "query_text string")
    queries = history.crossfit_queries(own, holdout)
    pairs = history.crossfit_pairs(history.history_pairs(own, _items(spark)), holdout)
    history.check_coverage(own, queries)
    with pytest.raises(ValueError, match="view"):
        history.check_coverage(own, queries.unionByName(queries.limit(1)))
    assert queries.join(pairs, ["view_id", "query_text"]).isEmpty()
    assert pairs.where("query_text = 'held'").isEmpty() and pairs.where("view_id = 5").count() == 60
    # other labels of a fold leave that fold's view as it was
    changed = own.withColumn("item_ids", F.when(F.crc32("query_text") % 2 == 0, F.array(F.lit("c"))).otherwise(F.col("item_ids")))
    fold = history.text_fold(F.col("query_text"))
    same = own.where(fold != 2).unionByName(changed.where(fold == 2))
    view = lambda c: sorted((r["query_text"], r["item_id"]) for r in history.crossfit_pairs(history.history_pairs(c, _items(spark)), holdout).where("view_id = 2").collect())
    assert view(own) == view(same)


def test_microcats(spark):
    pairs = history.history_pairs(_contexts(spark, [("x", 7, ["a", "b"]), ("x", 9, ["a"]), ("y", 7, ["c"])]), _items(spark))
    shares = {(r["query_text"], r["microcat"]): r["share"] for r in microcats.text_microcats(pairs).collect()}
    assert shares == {("x", "1"): pytest.approx(2 / 3), ("x", "2"): pytest.approx(1 / 3), ("y", "3"): 1.0}
    history_shares = spark.createDataFrame([("ремонт", "1", 1.0), ("баня", "2", 1.0)], "query_text string, microcat string, share double")
    neighbors = spark.createDataFrame([("q", "ремонт", 0.995), ("q", "баня", 0.1)], "query_id string, query_text string, score double")
    frame = spark.createDataFrame([("q", m) for m in "123"] + [("none", "1")], "query_id string, microcat string")
    got = {(r["query_id"], r["microcat"]): r for r in microcats.microcat_features(frame, *microcats.distribution(neighbors, history_shares)).collect()}
    assert got["q", "1"]["mc_prob"] > 0.99 and got["q", "2"]["mc_prob"] < 0.01 and got["q", "3"]["mc_prob"] == 0 and got["q", "1"]["mc_ratio"] == 1
    assert got["none", "1"]["mc_prob"] == 0 and got["none", "1"]["mc_ratio"] is None
    same = neighbors.withColumn("score", F.when(F.col("query_text") == "ремонт", 1.0).otherwise(F.lit(0.99)))
    exact = {r["microcat"]: r for r in microcats.microcat_features(frame.where("query_id = 'q'"), *microcats.distribution(same, history_shares, True)).collect()}
    assert [exact[m]["mc_prob"] for m in "12"] == [1, 0] and exact["1"]["mc_entropy"] == 0 and exact["1"]["mc_is_exact_match"] == 1


def test_centroids_and_ranks(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.5**0.5, 0.5**0.5])], "item_id string, embedding array<double>")
    pairs = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "b")], "query_text string, item_id string")
    neighbors = spark.createDataFrame([("q", "x", 1.0), ("q", "y", 0.2)], "query_id string, query_text string, score double")
    centroids = signals.neighbor_centroids(neighbors, signals.text_item_means(pairs, items))
    assert np.linalg.norm(centroids.first()["embedding"]) == pytest.approx(1)
    frame = spark.createDataFrame([("q", i, k) for k, i in enumerate("abc", 1)] + [("none", "b", 2), ("none", "a", 1)], "query_id string, doc_id string, rrf_rank int")
    got = {(r["query_id"], r["doc_id"]): r["nb_cos_rank"] for r in signals.cosine_features(frame, centroids, items, "nb_cos").collect()}
    assert [got["q", i] for i in "abc"] == [1, 3, 2] and [got["none", i] for i in "ab"] == [1, 2]
    counts = spark.createDataFrame([(100, 7, 9), (100, 9, 1)], "search_loc int, item_loc int, n long")
    assert [r["item_loc"] for r in signals.region_core(counts).collect()] == [7]


def test_recall(spark):
    rows = spark.createDataFrame([([1, 2, 3], [2, 9], 3), ([1, 1, 2], [2], 2), ([1, 1, 2], [1, 1, 2], 2), ([], [5], 3)], "p array<int>, r array<int>, k int")
    got = [r["x"] for r in rows.select(evaluation.recall_at_k(F.col("p"), F.col("r"), 2).alias("x")).collect()]
    assert got == [0.5, 0.0, 0.5, 0.0]  # repeats go after the cut
    with pytest.raises(Exception, match="without relevant"):
        spark.createDataFrame([([1], [])], "p array<int>, r array<int>").select(evaluation.recall_at_k(F.col("p"), F.col("r"), 2)).collect()


def _run(spark, recalls):
    return spark.createDataFrame([(f"q{k:03d}", r, 1.0, k % 2 == 0) for k, r in enumerate(recalls)], "query_id string, recall double, pool_recall double, filters_set boolean")


def test_comparisons(spark):
    a, b = _run(spark, [1.0] * 30 + [0.0] * 10), _run(spark, [0.0] * 40)
    got = {r["slice"]: r for r in evaluation.compare_runs(a, b, 400, {"filters_set": F.col("filters_set")}).collect()}
    assert {k: (r["n"], r["diff"], r["verdict"]) for k, r in got.items()} == {"overall": (40, 0.75, "better"), "filters_set": (20, 0.75, "better"), "pool": (40, 0.0, "undetermined")}
    assert {r["slice"]: r["verdict"] for r in evaluation.compare_runs(b, a, 400, {}).collect()} == {"overall": "worse", "pool": "undetermined"}
    for other in (b.limit(39), b.unionByName(b.limit(1))):
        with pytest.raises(ValueError, match="different queries"):
            evaluation.aligned(a, other)
    assert {r["recall"] for r in evaluation.average_runs([a, b]).collect()} == {0.5, 0.0}
    with pytest.raises(ValueError, match="missing"):
        evaluation.average_runs([a, b.limit(3)])


def test_bootstrap_interval(spark):
    """Near the interval of resampling with replacement, and the same for rows in any order."""
    diffs = spark.createDataFrame([(f"q{k}", float(k < 30)) for k in range(40)], "query_id string, diff double")
    got = evaluation.bootstrap(diffs, (), 2000).first()
    r = np.random.default_rng(3)
    means = (np.arange(40) < 30).astype(float)[r.integers(0, 40, (2000, 40))].mean(axis=1)
    assert (got["n"], got["diff"]) == (40, 0.75) and [got["low"], got["high"]] == pytest.approx(np.percentile(means, [2.5, 97.5]).tolist(), abs=0.05)
    assert evaluation.bootstrap(diffs.repartition(5), (), 2000).first() == got


def test_diagnostics(spark):
    ranked = spark.createDataFrame([("q0", "a", 1, 1, 1, 5.0, 1), ("q0", "b", 2, 60, 2, 9.0, 0), ("q1", "c", 1, 1, 1, None, None)], "query_id string, doc_id string, rrf_rank int, model_rank int, n_lists int, dist_km double, loc_match int")
    contexts = spark.createDataFrame([("q0", "x y", 7, "", ["a", "b"]), ("q1", "one two three four", 9, "Ремонт", ["c"]), ("q2", "z", None, "", ["gone"])], "query_id string, query_text string, search_loc int, filters string, item_ids array<string>")
    from sieveline.operators.features import item_table

    items = _items(spark)
    seen = spark.createDataFrame([("a",)], "item_id string")
    positives = diagnostics.positive_outcomes(contexts, ranked, item_table(items), geo.location_stats(items), seen).persist()
    assert positives.count() == 4 and positives.where("item_seen").count() == 1
    outcomes = {r["query_id"]: (r["recall"], r["pool_recall"], r["words"]) for r in diagnostics.query_outcomes(positives).collect()}
    assert outcomes == {"q0": (0.5, 1.0, "2"), "q1": (1.0, 1.0, "4+"), "q2": (0.0, 0.0, "1")}
    total = diagnostics.error_map(positives).first()
    assert total["recall"] + total["retrieval_loss"] + total["selection_loss"] == pytest.approx(1) and total["selection_loss"] == pytest.approx(1 / 6)
    by = {(r["by"], r["group"]): r for r in diagnostics.loss_breakdown(positives).collect()}
    assert {g for b, g in by if b == "model_rank"} == {"1-50", "51-100", "not_in_pool"}
    assert by["same_location", None]["positives"] == 1 and by["n_lists", "2"]["selection_loss"] == pytest.approx(1 / 6)
    buckets = spark.createDataFrame([(None,), (50,), (51,), (300,), (301,)], "r int").select(diagnostics.rank_bucket(F.col("r")).alias("b")).collect()
    assert [r["b"] for r in buckets] == ["not_in_pool", "1-50", "51-100", "101-300", ">300"]


def test_ranking(spark):
    frame = spark.createDataFrame([("q0", 1, 0.5, 2), ("q0", 2, 0.5, 1), ("q0", 3, 0.9, 3)], "query_id string, doc_id long, score double, rrf_rank int")
    queries = spark.createDataFrame([("q0",), ("q1",)], "query_id string")
    got = {r["query_id"]: r["doc_ids"] for r in ranker.select_top(frame, queries, 2).collect()}
    assert got == {"q0": [3, 2], "q1": []}
    rows = spark.range(80).select(F.concat(F.lit("q"), F.col("id") % 4).alias("query_id"), F.col("id").alias("doc_id"), (F.col("id") % 7).cast("double").alias("f"), F.when(F.col("id") % 5 == 0, None).otherwise(1.0).alias("g"), (F.col("id") % 7 > 3).cast("int").alias("label"), F.col("id").alias("rrf_rank"))
    model = ranker.train_gbt(rows, ["f", "g"], 2, 2)
    scored = ranker.predict_gbt(model, rows, ["f", "g"])
    assert scored.where("label = 1").agg(F.min("score")).first()[0] > scored.where("label = 0").agg(F.max("score")).first()[0]
    whole = {r["doc_id"]: r["score"] for r in scored.collect()}
    prefix = {r["doc_id"]: r["score"] for r in ranker.predict_gbt(model, rows, ["f", "g"], 2).collect()}
    # the model's margin is twice the ensemble's sum
    assert all(2 * prefix[i] == pytest.approx(whole[i], abs=1e-6) or prefix[i] == pytest.approx(whole[i], abs=1e-6) for i in whole)
    assert ranker.importances(model, ["f", "g"])[0][0] == "f"


def test_answers(spark):
    ids = [f"{i:016x}" for i in range(60)]
    queries = spark.createDataFrame([("70DfDUpwjxB4lzFd",), ("0000000000000001",)], "query_id string")
    items = spark.createDataFrame([(i,) for i in ids], "item_id string")
    good = submission.answer_frame(spark.createDataFrame([("70DfDUpwjxB4lzFd", ids), ("0000000000000001", ids[:2])], "query_id string, doc_ids array<string>"))
    assert len(good.where("query_id like '7%'").first()["answer"].split(" ")) == 50
    assert submission.validate_answer(good, queries, items).isEmpty()
    bad = spark.createDataFrame([("70DfDUpwjxB4lzFd", ""), ("70DfDUpwjxB4lzFd", f"{ids[0]} {ids[0]}"), ("short", "zz")], "query_id string, answer string")
    got = sorted((r["query_id"], r["violation"]) for r in submission.validate_answer(bad, queries, items).collect())
    assert got == [("0000000000000001", "missing query"), ("70DfDUpwjxB4lzFd", "duplicate items"), ("70DfDUpwjxB4lzFd", "duplicate query"), ("70DfDUpwjxB4lzFd", "empty"), ("short", "extra query"), ("short", "malformed or outside"), ("short", "query id length")]
    assert "schema" in submission.validate_answer(queries, queries, items).first()["violation"]


def test_triples_and_batches(spark):
    hits = spark.createDataFrame([("q", k, k + 1) for k in range(10)], "query_id string, doc_id long, rank int")
    contexts = spark.createDataFrame([("q", "t", [5]), ("r", "t", [7])], "query_id string, query_text string, item_ids array<long>")
    got = finetune.pick_triples(hits, contexts, 6, 9).collect()
    assert [(r["query_id"], r["pos"]) for r in got] == [("q", 5)] and got[0]["neg"] in {6, 8}
    batches = list(finetune.unique_batches([("a", 1, 2), ("a", 3, 4), ("b", 2, 5), ("c", 6, 7), ("d", 8, 8)], 2))
    assert batches == [[("a", 1, 2), ("c", 6, 7)], [("a", 3, 4), ("b", 2, 5)]]


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0, ""), ("a", 2.0, None), ("b", 4.0, "x"), ("b", 4.0, "x"), (None, 9.0, " ")], "id string, v double, t string")
    one = profile.integrity(df, "id", "^[a]$", "d").first()
    assert (one["n_rows"], one["duplicate_rows"], one["null_ids"], one["malformed_ids"], one["unique_ids"]) == (5, 1, 1, 2, 2)
    assert {r["column"]: (r["null_percent"], r["blank_percent"]) for r in profile.missingness(df, "d").collect()}["t"] == (20.0, 40.0)
    assert {r["column"]: r["conflicting_keys"] for r in profile.conflicts(df, "id", ["v", "t"]).collect()} == {"v": 1, "t": 1}
    assert profile.quantiles(df, "v", "d").first()["p50"] == 4.0
    assert [(r["value"], r["n"]) for r in profile.top_values(df, "id", "d", 2).collect()] == [("a", 2), ("b", 2)]


# The contract that stored models are read by.
CONTRACT = """rank_bm25_global score_bm25_global rank_bm25_local score_bm25_local rank_dense_global score_dense_global rank_dense_local score_dense_local rrf rrf_rank n_lists dense_sim title_overlap params_overlap
loc_match dist_km cat_match query_cat_zero filters_empty query_words location_items price rating reviews phone_hidden message_forbidden title_chars params_chars description_chars
rank_bm25_radius score_bm25_radius rank_dense_radius score_dense_radius center_source hist_pairs trans_prob trans_pairs trans_support trans_unknown trans_lift trans_targets trans_outside_share geo_unreliable log_dist_clean
mc_prob mc_ratio mc_entropy mc_top_sim nb_cos nb_cos_rank enc2_sim enc2_rank""".split()


def test_the_feature_contract_and_its_order():
    assert SearchConfig().features() == CONTRACT and len(set(CONTRACT)) == 52


def test_configuration():
    config = SearchConfig()
    lists = config.retrieval
    assert lists.list_names() == ["bm25_global", "dense_global", "bm25_local", "dense_local", "bm25_radius", "dense_radius"] and lists.list_depth("bm25_radius") == 50
    more = RetrievalConfig(channels=("bm25",), local=False, depth_geo=20, geo_km=80, geo_weight=0.6, depth_region=5)
    assert more.list_names() == ["bm25_global", "bm25_radius", "bm25_geo", "dense_region"] and [more.list_depth(n) for n in more.list_names()] == [400, 50, 20, 5]
    assert more.features()[-4:] == ["rank_bm25_geo", "score_bm25_geo", "rank_dense_region", "score_dense_region"]
    assert len({c.report_name("dev") for c in (lists, more, RetrievalConfig(geo_weight=0.5), RetrievalConfig(bm25=BM25Config(stem=True)), RetrievalConfig(dense=EncoderConfig(revision="2")))}) == 5
    assert EncoderConfig(query_filters=False).passage_tag() == EncoderConfig().passage_tag() != EncoderConfig(params_chars=9).passage_tag()
    assert config.needs_history() and not SearchConfig(RetrievalConfig(depth_radius=0), FeatureConfig("none", "none", False, microcats="none", centroid=False)).needs_history()
    assert from_contract(config.contract()) == config
    check_model(config.contract(), config)
    swapped = config.contract()
    swapped["features"][:2] = swapped["features"][1::-1]
    with pytest.raises(ValueError, match="another order"):
        check_model(swapped, config)
    with pytest.raises(ValueError, match="features"):
        check_model(config.contract(), SearchConfig(blocks=FeatureConfig(microcats="exact")))
    with pytest.raises(ValueError, match="candidates"):
        check_model(config.contract(), SearchConfig(RetrievalConfig(rrf_k=61)))
    with pytest.raises(ValueError, match="blocks"):
        check_model(config.contract(), SearchConfig(blocks=FeatureConfig(alpha=1.0)))
    with pytest.raises(ValueError, match="not a model"):
        from_contract({"retrieval": {"channels": []}})
    with pytest.raises(ValueError, match="deeper"):
        RetrievalConfig(depth_radius=500)
    with pytest.raises(ValueError, match="damping"):
        FeatureConfig(geo="none")


def test_contrastive_loss_and_training():
    eye = np.eye(3)
    close, _, _ = contrastive.contrastive_loss(eye, np.concatenate([eye, -eye]), 20.0)
    apart, _, _ = contrastive.contrastive_loss(eye, np.concatenate([eye[[1, 2, 0]], eye]), 20.0)
    assert close < 1e-6 < 10 < apart
    # the gradient of a batch against differences of its loss
    batch = [("red lamp", "a red lamp", "a blue chair"), ("oak table", "table of oak", "a lamp")]
    m, h = contrastive.start(1, 64, 8), 1e-6
    _, g = contrastive.step_gradient(m, batch, 5.0)
    r = np.random.default_rng(4)
    for i, j in zip(r.integers(0, 64, 8), r.integers(0, 8, 8), strict=True):
        up, down = m.copy(), m.copy()
        up[i, j] += h
        down[i, j] -= h
        assert g[i, j] == pytest.approx((contrastive.step_gradient(up, batch, 5.0)[0] - contrastive.step_gradient(down, batch, 5.0)[0]) / (2 * h), abs=1e-6)
    words = [f"w{k}" for k in range(24)]
    triples = [(f"{w} seek", f"{w} {w}x offer", f"other{k} thing") for k, w in enumerate(words)]
    trained, losses = contrastive.train(contrastive.start(1, 256, 16), triples, contrastive.TrainConfig(batch=8, epochs=30, rate=0.02))
    assert losses[-1] < losses[0] / 4
    make = contrastive.encoder(trained)()
    q, d = make([t[0] for t in triples]), make([t[1] for t in triples])
    assert ((q @ d.T).argmax(axis=1) == np.arange(24)).mean() > 0.9


def test_streamed_history_counts_equal_the_batch(spark, tmp_path):
    events = spark.range(400).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("int").alias("search_loc"), (F.col("id") % 5).cast("int").alias("item_loc"))
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream.start(source, ["search_loc", "item_loc"], str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    windows = spark.read.parquet(str(tmp_path / "out"))
    last = windows.agg(F.max("start")).first()[0]
    batch = stream.windowed_counts(events, ["search_loc", "item_loc"]).where(F.col("start") <= F.lit(last))
    key = lambda df: sorted(map(tuple, stream.merged(df, ["search_loc", "item_loc"]).collect()))
    assert windows.count() > 0 and key(windows) == key(batch)
