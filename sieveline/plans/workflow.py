"""The four jobs: prepare a split, embed a corpus, train a ranker, predict an answer.

Each reads and writes folders that every executor reaches; nothing passes through the driver but
configurations, reports and models. ``python -m sieveline`` runs them from the command line.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import digest_id
from sieveline.operators import contrastive, dense, encode, evaluation, features, finetune, history, ranker, report, split, submission, tables
from sieveline.plans import search
from sieveline.plans.config import SearchConfig, check_model, from_contract
from sieveline.sources import io

SECOND = encode.EncoderConfig(model="hashed-128")
encode.register("hashed-128", "1", encode.hashed_encoder(128))


def listings(corpus: DataFrame) -> DataFrame:
    """The corpus' columns by the names that the operators use; keys are text."""
    own = {
        "item_id": "item_id", "item_title_raw": "title", "item_description_raw": "description", "item_infm_params_text": "params", "item_price": "price", "item_rating": "rating", "item_rating_reviews_count": "reviews",
        "item_location_id": "loc", "item_latitude": "lat", "item_longitude": "lon", "item_is_phone_hidden": "phone_hidden", "item_is_message_forbidden": "message_forbidden",
    }
    text = lambda c, name: F.col(c).cast("string").alias(name)
    return corpus.select(*(F.col(c).alias(n) for c, n in own.items()), text("item_category_id", "category"), text("item_microcat_id", "microcat"))


def asked(contexts: DataFrame) -> DataFrame:
    """Queries by the names that the operators use, with the chosen items where they are known."""
    cols = [F.col("query_id"), F.col("query_text"), F.col("search_location_id").alias("search_loc"), F.col("search_infm_params_text").alias("filters"), F.col("search_category").cast("string").alias("category")]
    return contexts.select(*cols, *(["item_ids"] if "item_ids" in contexts.columns else []))


def prepare_split(spark: SparkSession, train: str, out: str) -> dict[str, int]:
    """Parts, contexts by part, evaluation samples and the item corpus; returns their row counts."""
    log = io.load_train(spark, train)
    parts = split.assign_parts(log)
    if not split.disjoint(parts):
        raise ValueError("a text is in two parts")
    io.write_table(parts, f"{out}/text_parts.parquet")
    contexts = split.build_contexts(tables.join_unique(log, parts, ["query_text"]), [*io.CONTEXT_COLS, "part"])
    io.write_table(contexts, f"{out}/contexts.parquet", ["part"])
    contexts = spark.read.parquet(f"{out}/contexts.parquet")
    for part in ("dev", "test"):
        io.write_table(split.sample_queries(contexts.where(F.col("part") == part)), f"{out}/eval_{part}.parquet")
    io.write_table(contexts.where("part = 'train'"), f"{out}/contexts_train.parquet")
    io.write_table(split.build_corpus(log.select(io.ITEM_COLS)), f"{out}/{io.CORPORA['split']}")
    return {r["part"]: r["count"] for r in contexts.groupBy("part").count().collect()}


def embed(items: DataFrame, path: str, config: encode.EncoderConfig) -> DataFrame:
    """Items with the vectors of their passages, from a store at ``path`` that is filled first."""
    spark = items.sparkSession
    passages = items.select(F.col("item_id").alias("id"), encode.passage_text(F.col("title"), F.col("params"), F.col("description"), config.params_chars).alias("text"))
    tag = config.passage_tag()
    io.save_embeddings(passages, f"{path}/{tag}", tag, lambda df: encode.encode(df, "id", "text", encode.load_model(config), config.batch))
    return items.join(io.load_embeddings(spark, f"{path}/{tag}", passages, tag).withColumnRenamed("id", "item_id"), "item_id")


def _query_vectors(queries: DataFrame, path: str, config: encode.EncoderConfig) -> DataFrame:
    """query_id and embedding, through the cache of texts."""
    texts = queries.select("query_id", encode.query_text(F.col("query_text"), F.col("filters"), config.query_filters).alias("text"))
    found = io.text_vectors(texts, f"{path}/texts", config.tag(), lambda df: encode.encode(df, "text", "text", encode.load_model(config), config.batch))
    return texts.join(found, "text").select("query_id", "embedding")


def _past_vectors(past: DataFrame, path: str, config: encode.EncoderConfig) -> DataFrame:
    texts = past.select("query_text").distinct().withColumn("text", encode.query_text(F.col("query_text"), F.lit(None).cast("string"), False))
    found = io.text_vectors(texts, f"{path}/texts", config.tag(), lambda df: encode.encode(df, "text", "text", encode.load_model(config), config.batch))
    return texts.join(found, "text").select("query_text", "embedding")


def feature_frame(queries: DataFrame, items: DataFrame, past: DataFrame, config: SearchConfig, work: str) -> DataFrame:
    """The features of all candidates of ``queries``, every vector taken from the stores under ``work``."""
    own = embed(items, work, config.retrieval.dense)
    wanted = queries.join(_query_vectors(queries, work, config.retrieval.dense), "query_id")
    texts = _past_vectors(past, work, config.retrieval.dense) if config.needs_history() else None
    second = None
    if config.blocks.second_encoder:
        other = embed(items, work, SECOND)
        second = (_query_vectors(queries, work, SECOND), other.select("item_id", "embedding"))
    return search.frame(wanted, own, past, config, texts, second)


def train_frames(contexts: DataFrame, items: DataFrame, config: SearchConfig, work: str) -> dict[str, DataFrame]:
    """Labelled frames of the ranker's queries: fit and valid (queries with a positive candidate) and full_valid.

    No query meets choices of its own text: its features come from the other folds' choices, those of
    validation texts from all choices of other texts. Texts in the validation bucket that aren't in the
    fixed set are left out.
    """
    n, seed = config.ranker.queries, str(config.ranker.seed)
    valid = split.fixed_valid_texts(contexts, n, seed=seed)
    chosen = split.roles(split.sample_queries(contexts, n, seed), valid, seed=seed).where("not excluded")
    queries = history.crossfit_queries(asked(chosen), valid)
    past = history.crossfit_pairs(_pairs(contexts, items), valid)
    history.check_coverage(asked(chosen), queries)
    labelled = features.attach_labels(feature_frame(queries, items, past, config, work), queries)
    labelled.write.mode("overwrite").parquet(f"{work}/train_frame")
    labelled = labelled.sparkSession.read.parquet(f"{work}/train_frame")
    held = queries.where(F.col("view_id") == split.FOLDS).select("query_id")
    full_valid = labelled.join(held, "query_id", "left_semi")
    return {"fit": features.with_positive(labelled.join(held, "query_id", "left_anti")), "valid": features.with_positive(full_valid), "full_valid": full_valid, "valid_queries": queries.join(held, "query_id", "left_semi")}


def _pairs(contexts: DataFrame, items: DataFrame) -> DataFrame:
    return history.history_pairs(contexts.withColumnRenamed("search_location_id", "search_loc"), items)


def train(spark: SparkSession, root: str, out: str, config: SearchConfig) -> dict:
    """Fit a ranker on a prepared split, measure it on the development queries, store it with its contract; the report."""
    timings, names = tables.Timings(), config.features()
    work = f"{out}/work"
    items = listings(io.load_corpus(spark, root, "split"))
    contexts = spark.read.parquet(f"{root}/contexts_train.parquet")
    with timings.stage("frames"):
        frames = train_frames(contexts, items, config, work)
    r = config.ranker
    with timings.stage("fit"):
        model = ranker.train_gbt(frames["fit"], names, r.trees, r.depth, r.rate, r.seed)
    steps = sorted({max(1, r.trees // k) for k in (4, 2, 1)})
    curve = ranker.recall_curve(model, frames["full_valid"], frames["valid_queries"], names, steps).collect()
    _, queries, seen = io.load_eval(spark, root, "dev")
    queries = asked(queries)
    with timings.stage("dev"):
        # development texts are in no training context, so the whole history may be seen
        past = history.benchmark_history(contexts.withColumnRenamed("search_location_id", "search_loc"), items)
        frame = feature_frame(history.full_view(queries), items, past, config, work)
        scored = ranker.predict_gbt(model, features.check_contract(frame, names, keep=["rrf_rank"]), names)
        got = ranker.select_top(scored, queries, max(evaluation.KS))
        got.write.mode("overwrite").parquet(f"{out}/predictions")
        per_query = queries.join(spark.read.parquet(f"{out}/predictions"), "query_id")
        io.write_table(evaluation.per_query(per_query), f"{out}/per_query")
        metrics = evaluation.recall_report(spark.read.parquet(f"{out}/predictions"), queries, seen).collect()
    io.save_model(spark, model, config.contract(), f"{out}/ranker")
    done = {
        "name": config.retrieval.report_name("dev"), "metrics": {m["metric"]: m["value"] for m in metrics}, "curve": {str(c["trees"]): c["recall"] for c in curve},
        "importances": ranker.importances(model, names)[:20], "timings": dict(timings), "peak_rss_gb": tables.peak_rss_gb(), "git": tables.git_state("."), "environment": {e["name"]: e["version"] for e in io.environment(spark).collect()}, "config": asdict(config),
    }
    io.write_json(spark, done, f"{out}/report.json")
    report.write_html(spark, f"{out}/report.html", "Ranker", {"metrics": spark.read.parquet(f"{out}/per_query").describe("recall", "pool_recall"), "environment": io.environment(spark)}, {"configuration": done["name"]})
    return done


def compare(spark: SparkSession, a: str, b: str, resamples: int = evaluation.RESAMPLES) -> DataFrame:
    """The runs stored at two paths, compared by query."""
    return evaluation.compare_runs(spark.read.parquet(f"{a}/per_query"), spark.read.parquet(f"{b}/per_query"), resamples)


def predict(spark: SparkSession, model_path: str, queries_path: str, corpus: DataFrame, log: DataFrame, output: str, work: str, config: SearchConfig | None = None, id_length: int = submission.ID_LENGTH, item_id: str = submission.ITEM_ID) -> dict:
    """Answer the queries at a path with a stored model, validate, write, read again; the answer's description.

    ``log``: contexts of the whole training log. An existing output is refused before anything is computed.
    """
    if io.exists(spark, output):
        raise ValueError(f"{output} exists")
    model, contract = io.load_model(spark, model_path)
    config = config or from_contract(contract)
    check_model(contract, config)
    timings, names = tables.Timings(), config.features()
    raw = io.prepare_queries(spark.read.parquet(queries_path))
    if "query_id" not in raw.columns:
        raw = raw.withColumn("query_id", digest_id(*(F.col(c) for c in io.CONTEXT_COLS)))
    queries, items = asked(raw.dropDuplicates(["query_id"])), listings(corpus)
    past = history.benchmark_history(log.withColumnRenamed("search_location_id", "search_loc"), items)  # read only where a block needs it
    with timings.stage("frame"):
        frame = feature_frame(history.full_view(queries), items, past, config, work)
        scored = ranker.predict_gbt(model, features.check_contract(frame, names, keep=["rrf_rank"]), names)
        scored.select("query_id", "doc_id", "rrf_rank", "score").write.mode("overwrite").parquet(f"{work}/scored")
    with timings.stage("answer"):
        answer = search.answer(spark.read.parquet(f"{work}/scored"), queries, items, id_length=id_length, item_id=item_id)
        io.write_answer(answer, output)
    if not io.same_rows(io.read_answer(spark, output).fillna({"answer": ""}), answer):
        raise ValueError("the answer read back is another one")
    meta = {"queries": queries.count(), "model": contract, "timings": dict(timings), "answer": io.digest(answer, "query_id", "answer"), "git": tables.git_state(".")}
    io.write_json(spark, meta, f"{output}.meta.json")
    return meta


def finetune_encoder(spark: SparkSession, root: str, work: str, config: SearchConfig, name: str, settings: contrastive.TrainConfig = contrastive.TrainConfig()) -> tuple[Callable, list[float]]:  # noqa: B008
    """Train an encoder on contexts and hard negatives of the local lists, and register it under ``name``; its factory and losses.

    Texts that the ranker is validated on are left out, and a text gives a few contexts only.
    """
    items = listings(io.load_corpus(spark, root, "split"))
    contexts = spark.read.parquet(f"{root}/contexts_train.parquet")
    valid = split.fixed_valid_texts(contexts, config.ranker.queries)
    few = finetune.few_per_text(contexts.join(valid, "query_text", "left_anti"))
    queries = asked(few)
    own = embed(items, work, config.retrieval.dense).select(F.col("item_id").alias("doc_id"), "embedding", "loc")
    wanted = queries.join(_query_vectors(queries, work, config.retrieval.dense), "query_id").select("query_id", "embedding", F.col("search_loc").alias("loc"))
    triples = finetune.pick_triples(dense.search(own, wanted, finetune.HIGH, "loc"), queries)
    passage = items.select("item_id", encode.passage_text(F.col("title"), F.col("params"), F.col("description")).alias("passage"))
    texts = triples.join(queries, "query_id").select("query_id", encode.query_text(F.col("query_text"), F.col("filters")).alias("asked"), "pos", "neg")
    for side in ("pos", "neg"):
        texts = texts.join(passage.withColumnsRenamed({"item_id": side, "passage": f"{side}_text"}), side)
    rows = texts.orderBy("query_id").select("asked", "pos_text", "neg_text").collect()  # a few contexts of each text, as the trainer runs on the driver
    matrix, losses = contrastive.train(contrastive.start(settings.seed), [tuple(r) for r in rows], settings)
    make = contrastive.encoder(matrix)
    encode.register(name, "1", make)
    return make, losses
