"""The search plan end to end, the encoder interface, the command line and the registry."""

import math

import pytest
from pyspark.sql import functions as F

from sieveline.__main__ import main
from sieveline.operators import contrastive, encode, history, ranker
from sieveline.operators.lexical import BM25Config
from sieveline.plans import catalog, search, workflow
from sieveline.plans.config import FeatureConfig, RankerConfig, RetrievalConfig, SearchConfig
from sieveline.sources import io

PLACES = [(7, 55.0, 37.0), (9, 55.1, 37.1), (11, 60.0, 30.0)]


def _world(spark):
    words = WORDS
    rows = []
    for k in range(36):
        loc, lat, lon = PLACES[k % 3]
        a, b = words[k % 6], words[(k // 6) % 6]
        rows.append((f"{k:016x}", f"{a} {b}", f"вид {a}", f"описание {k}", loc, lat, lon, str(k % 4), str(k % 6), 10.0 * k, 4.5, k, k % 2 == 0, False, [math.cos(k), math.sin(k)]))
    items = spark.createDataFrame(rows, "item_id string, title string, params string, description string, loc int, lat double, lon double, category string, microcat string, price double, rating double, reviews int, phone_hidden boolean, message_forbidden boolean, embedding array<double>")
    queries = spark.createDataFrame([(f"query{k:011d}", words[k], 7 if k < 3 else 55, "", "0", [math.cos(k + 0.1), math.sin(k + 0.1)]) for k in range(5)], "query_id string, query_text string, search_loc int, filters string, category string, embedding array<double>")
    contexts = spark.createDataFrame([(f"c{k}", words[k % 6], (7, 55)[k % 2], [f"{k:016x}", f"{k + 6:016x}"]) for k in range(20)], "query_id string, query_text string, search_loc int, item_ids array<string>")
    return items, queries, history.history_pairs(contexts, items)


LISTS = RetrievalConfig(depth_global=20, depth_local=10, depth_radius=10, depth_geo=10, geo_km=60, geo_weight=0.6, depth_region=5, bm25=BM25Config(title_repeat=3, query_filters=True, stem=True, stop_words=True))


def _texts(past, words):
    """Vectors of past texts beside those of the queries."""
    at = F.element_at(F.create_map(*[x for k, w in enumerate(words) for x in (F.lit(w), F.lit(float(k)))]), F.col("query_text"))
    return past.select("query_text").distinct().withColumn("embedding", F.array(F.cos(at + 0.1), F.sin(at + 0.1)))


WORDS = ["ремонт", "баня", "стрижка", "окна", "двери", "кухня"]


def test_search_end_to_end(spark):
    items, queries, past = _world(spark)
    config = SearchConfig(LISTS, FeatureConfig(geo="full", fields="filters", microcats="exact", filters=True))
    second = (queries.select("query_id", "embedding"), items.select("item_id", "embedding"))
    out = search.frame(queries, items, past, config, _texts(past, WORDS), second).persist()
    missing = [f for f in config.features() if f not in out.columns]
    assert not missing
    assert out.groupBy("query_id", "doc_id").count().where("count > 1").isEmpty()
    # unknown places take their centre from the history; the radius lists hold only near items
    assert {r["center_source"] for r in out.where("search_loc = 55").select("center_source").distinct().collect()} == {1}
    assert out.where("rank_bm25_radius is not null or rank_dense_radius is not null").where("dist_km > 25").isEmpty()
    assert out.where("rank_bm25_geo is not null or rank_dense_geo is not null").where("dist_km > 60").isEmpty()
    assert out.where("rank_bm25_local is not null and item_loc <> search_loc").isEmpty()
    assert out.where("rank_dense_region is not null").count() > 0
    # every query's own text was searched before
    assert {r["mc_is_exact_match"] for r in out.select("mc_is_exact_match").distinct().collect()} == {1}
    scored = out.withColumn("score", ranker.linear_score())
    answer = search.answer(scored, queries, items)
    assert {r["query_id"] for r in answer.collect()} == {r["query_id"] for r in queries.collect()}
    with pytest.raises(ValueError, match="outside"):
        search.answer(scored, queries, items.limit(1))


def test_features_of_a_view_don_t_depend_on_its_own_texts_choices(spark):
    """Cross-fitted frames of two histories that differ in one text's choices: that text's features are the same."""
    items, queries, past = _world(spark)
    config = SearchConfig(RetrievalConfig(depth_global=36, depth_local=10, depth_radius=0), FeatureConfig(microcats="exact", second_encoder=False))
    none = past.select("query_text").limit(0)
    own = history.crossfit_queries(queries, none)
    changed = past.withColumn("search_loc", F.when(F.col("query_text") == WORDS[0], 7).otherwise(F.col("search_loc"))).withColumn("microcat", F.when(F.col("query_text") == WORDS[0], "other").otherwise(F.col("microcat")))

    def features(pairs):
        out = search.frame(own, items, history.crossfit_pairs(pairs, none), config, _texts(past, WORDS))
        return {(r["query_id"], r["doc_id"]): [r[f] for f in config.blocks.features()] for r in out.collect()}

    a, b = features(past), features(changed)
    same = {r["query_id"] for r in own.where(F.col("view_id") == history.text_fold(F.lit(WORDS[0]))).collect()}
    mine = {r["query_id"] for r in own.where(F.col("query_text") == WORDS[0]).collect()}
    assert mine <= same and all(a[k] == b[k] for k in a if k[0] in same)
    assert any(a[k] != b[k] for k in a if k[0] not in same)


def test_overlaps_of_the_search_plan_are_those_of_stems(spark):
    items, queries, past = _world(spark)
    config = SearchConfig(RetrievalConfig(depth_global=20, depth_local=10, depth_radius=10), FeatureConfig("none", "none", False, microcats="none", centroid=False, second_encoder=False))
    out = search.frame(queries.limit(1).withColumn("query_text", F.lit("ремонтом")), items, past, config)
    got = {r["doc_id"]: (r["title_overlap"], r["params_overlap"]) for r in out.collect()}
    titles = {r["item_id"]: (float("ремонт" in r["title"]), float("ремонт" in r["params"])) for r in items.collect()}
    assert got and all(titles[i] == x for i, x in got.items()) and (1.0, 1.0) in got.values()


def test_encoder_interface(spark):
    docs = spark.createDataFrame([(1, "ремонт окон"), (2, None), (3, "ремонт окон")], "k long, t string")
    got = {r["k"]: r["embedding"] for r in encode.encode(docs, "k", "t").collect()}
    assert got[1] == got[3] and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and not any(got[2])
    assert encode.truncation_share(docs, "t", 1).first()["share"] == pytest.approx(2 / 3)
    row = spark.createDataFrame([("Ремонт  холодильников", "Вид услуги Ремонт", None, "маникюр", "Вид услуги Красота")], "t string, p string, d string, q string, f string")
    assert row.select(encode.passage_text(F.col("t"), F.col("p"), F.col("d"), 10).alias("x")).first()["x"] == "passage: Ремонт холодильников\nВид услуги"
    assert row.select(encode.query_text(F.col("q"), F.col("f")).alias("x")).first()["x"] == "query: маникюр. Вид услуги Красота"


def test_command_line(spark, tmp_path):
    main(["query", "top_values", "/root/testdata/sf0.001", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    with pytest.raises(SystemExit):
        main(["query", "nothing", "x", "y"])


def _log(spark):
    items, _, _ = _world(spark)
    base = items.select("item_id", F.col("title").alias("item_title_raw"), F.col("description").alias("item_description_raw"), F.col("params").alias("item_infm_params_text"), F.lit(1).alias("item_category_id"), F.col("microcat").alias("item_microcat_id"), F.col("price").alias("item_price"), F.col("rating").alias("item_rating"), F.col("reviews").alias("item_rating_reviews_count"), F.col("loc").alias("item_location_id"), F.col("lat").alias("item_latitude"), F.col("lon").alias("item_longitude"), F.col("phone_hidden").alias("item_is_phone_hidden"), F.col("message_forbidden").alias("item_is_message_forbidden"))
    return base.crossJoin(spark.range(3)).select("*", F.concat(F.col("item_title_raw"), F.lit(" "), F.col("id")).alias("search_query"), F.lit(7).alias("search_location_id"), F.lit(False).alias("search_is_delivery_search"), F.lit(None).cast("string").alias("search_infm_params_text"), F.lit(1).alias("search_category")).drop("id")


def test_from_a_log_to_a_validated_answer(spark, tmp_path, capsys):
    """The jobs one after the other by the command line: split, train, store, load, predict, compare."""
    log, at = _log(spark), lambda name: str(tmp_path / name)
    log.write.parquet(at("log"))
    main(["prepare-split", at("log"), at("split")])
    parts = {r["part"]: r["count"] for r in spark.read.parquet(at("split/contexts.parquet")).groupBy("part").count().collect()}
    assert sum(parts.values()) == log.select("search_query").distinct().count() and set(parts) == {"train", "dev", "test"}
    assert io.load_corpus(spark, at("split"), "split").count() == 36
    light = FeatureConfig("none", "none", False, microcats="none", centroid=False, second_encoder=False)
    config = SearchConfig(RetrievalConfig(channels=("bm25",), local=False, depth_global=20, depth_radius=0), light, RankerConfig(trees=2, depth=2, rate=0.3, queries=60))
    io.write_json(spark, config.contract(), at("config.json"))
    main(["train", at("split"), at("run"), "--config", at("config.json")])
    done = io.read_json(spark, at("run/report.json"))
    assert done["metrics"]["recall@50"] > 0 and set(done["curve"]) == {"1", "2"} and done["environment"]["spark"] == spark.version and "recall" in (tmp_path / "run/report.html").read_text()
    _, contract = io.load_model(spark, at("run/ranker"))
    assert contract == config.contract()
    with pytest.raises(ValueError, match="exists"):
        io.save_model(spark, None, contract, at("run/ranker"))
    assert not spark.read.parquet(at("run/work/train_frame")).where("label = 1").isEmpty()
    asked = log.where("search_query like '% 1'").select(*(c for c in log.columns if c.startswith("search_"))).distinct()
    asked.write.parquet(at("asked"))
    main(["predict", at("run/ranker"), at("asked"), at("split"), at("answer"), "--work", at("work")])
    answer = io.read_answer(spark, at("answer"))
    assert answer.count() == asked.count() and answer.where("answer is null").isEmpty()
    assert io.read_json(spark, at("answer.meta.json"))["model"] == contract
    again = ["predict", at("run/ranker"), at("asked"), at("split")]
    with pytest.raises(ValueError, match="exists"):
        main([*again, at("answer")])
    other = SearchConfig(config.retrieval, FeatureConfig(microcats="exact"), config.ranker)
    io.write_json(spark, other.contract(), at("other.json"))
    with pytest.raises(ValueError, match="features"):
        main([*again, at("second"), "--config", at("other.json")])
    main(["compare", at("run"), at("run")])
    assert "undetermined" in capsys.readouterr().out


def test_embedding_and_finetuning_jobs(spark, tmp_path, capsys):
    _log(spark).write.parquet(str(tmp_path / "log"))
    workflow.prepare_split(spark, str(tmp_path / "log"), str(tmp_path / "split"))
    main(["embed", str(tmp_path / "split"), str(tmp_path / "work")])
    assert "36" in capsys.readouterr().out
    make, losses = workflow.finetune_encoder(spark, str(tmp_path / "split"), str(tmp_path / "work"), SearchConfig(ranker=RankerConfig(queries=10)), "tuned", contrastive.TrainConfig(batch=4, epochs=2, rate=0.01))
    assert losses and all(math.isfinite(x) for x in losses)
    config = encode.EncoderConfig(model="tuned")
    items = workflow.embed(workflow.listings(io.load_corpus(spark, str(tmp_path / "split"), "split")), str(tmp_path / "work"), config)
    assert items.count() == 36 and len(items.first()["embedding"]) == contrastive.DIMENSIONS
    with pytest.raises(ValueError, match="unknown model"):
        encode.load_model(encode.EncoderConfig(model="nothing"))
    with pytest.raises(ValueError, match="another model"):
        encode.register("tuned", "1", encode.hashed_encoder(8))


def test_every_oracle_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 70
