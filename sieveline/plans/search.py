"""The two-stage search end to end: candidates, features, ranking, answer.

Everything is one lazily composed plan with three cuts that callers may persist: the lists, the
feature frame and the answer. Queries and past choices carry a view (``view_id``): a query's features
come from the choices that its view may see, so a training query never meets its own text's. Run
``python -m sieveline --help`` for the command line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import filter_match, normalize_text, parse_filters
from sieveline.operators import dense, encode, features, fusion, geo, history, lexical, microcats, ranker, signals, submission
from sieveline.plans.config import BASE, COMPUTED, FILTERS, RetrievalConfig, SearchConfig

VIEW = ("view_id",)


def _viewed(df: DataFrame) -> DataFrame:
    return df if "view_id" in df.columns else history.full_view(df)


def lists(queries: DataFrame, items: DataFrame, centers: DataFrame, config: RetrievalConfig) -> dict[str, tuple[DataFrame, int]]:
    """Every list that the configuration uses, with its depth.

    ``queries``: query_id, query_text, filters, search_loc, view_id and, for dense lists, embedding. ``items``:
    item_id, title, params, description, loc, lat, lon and embedding. ``centers``: view_id, search_loc, lat, lon.
    A geographic list ranks by scores that are damped for items of other places; with ``geo_km`` only items
    within that distance of the query's centre compete.
    """
    documents = items.select(F.col("item_id").alias("doc_id"), lexical.item_document(F.col("title"), F.col("params"), F.col("description"), config.bm25.title_repeat).alias("text"))
    asked = queries.select("query_id", lexical.query_text(F.col("query_text"), F.col("filters"), config.bm25.query_filters).alias("text"), "search_loc")
    idx = lexical.index(documents, config=config.bm25) if "bm25" in config.channels else None
    places = items.select(F.col("item_id").alias("doc_id"), "loc", "lat", "lon")
    vectors = items.select(F.col("item_id").alias("doc_id"), "embedding", "loc")
    wanted = queries.select("query_id", "embedding", F.col("search_loc").alias("loc"))

    def allowed(km: float) -> DataFrame:
        # centres, not queries, go into the radius join: far fewer circles than queries
        named = centers.withColumn("center_id", F.struct("view_id", "search_loc"))
        near = geo.radius_join(named.select("center_id", "lat", "lon"), places, km).select("center_id.*", "doc_id")
        return queries.select("query_id", "view_id", "search_loc").join(near, ["view_id", "search_loc"]).select("query_id", "doc_id")

    def hits(channel: str, scope: str, k: int) -> DataFrame:
        km = {"radius": config.radius_km, "geo": config.geo_km}.get(scope, 0.0)
        if scope == "local":
            return lexical.search_local(idx, asked, k, "search_loc", places) if channel == "bm25" else dense.search(vectors, wanted, k, "loc")
        if not km:
            return lexical.search(idx, asked, k) if channel == "bm25" else dense.search(vectors, wanted, k)
        if channel == "bm25":
            return lexical.search_groups(idx, asked, k, allowed(km))
        return lexical.top_k(dense.pair_similarity(allowed(km), queries, vectors, "score").where("score is not null"), k)

    found = {}
    for name in config.list_names():
        channel, scope = name.split("_", 1)
        if scope == "region":
            continue  # needs history: see ``region_list``
        got = hits(channel, scope, COMPUTED[scope])
        if scope == "geo":
            placed = got.join(places.select("doc_id", "loc"), "doc_id").join(queries.select("query_id", "search_loc"), "query_id")
            got = fusion.geo_rerank(placed, F.col("search_loc"), F.col("loc"), config.geo_weight, config.geo_delta).select("query_id", "doc_id", "rank", "score")
        found[name] = (got, config.list_depth(name))
    return found


def region_list(centroids: DataFrame, counts: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k best items by the query's centroid within the core places of its searched place."""
    core = signals.region_core(counts).select("search_loc", "item_loc")
    pairs = queries.select("query_id", "search_loc").join(core, "search_loc").join(items.select(F.col("item_id").alias("doc_id"), F.col("loc").alias("item_loc")), "item_loc").select("query_id", "doc_id")
    vectors = items.select(F.col("item_id").alias("doc_id"), "embedding")
    return lexical.top_k(dense.pair_similarity(pairs, centroids, vectors, "score").where("score is not null"), k)


def past_texts(past: DataFrame, make: Callable[[], encode.Encoder] | None = None) -> DataFrame:
    """query_text and embedding of each distinct past text, encoded without filters."""
    texts = past.select("query_text").distinct().withColumn("asked", encode.query_text(F.col("query_text"), F.lit(None).cast("string"), False))
    return encode.encode(texts, "query_text", "asked", make)


def frame(queries: DataFrame, items: DataFrame, past: DataFrame, config: SearchConfig, texts: DataFrame | None = None, second: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The feature frame of all candidates: query_id, doc_id and what the configuration's blocks add.

    ``past``: query_text, search_loc, item_id, item_loc, microcat, lat, lon of past choices. ``queries``
    and ``past`` may have view_id; without it all queries see all choices. ``texts``: vectors of past
    texts (see :func:`past_texts`) for neighbours. ``second``: vectors of queries and of items
    (item_id) by the second encoder.
    """
    queries, past, blocks, retrieval = _viewed(queries), _viewed(past), config.blocks, config.retrieval
    stats = geo.location_stats(items)
    hist = geo.location_centers(past, VIEW)
    centers = geo.query_centers(queries, stats, hist, VIEW).where("center_source < 2")
    extra = {}
    if texts is not None:
        visible, asked = past.select("view_id", "query_text", "microcat"), queries.select("query_id", "view_id", "embedding")
        means = signals.text_item_means(past, items)
        centroids = signals.neighbor_centroids(microcats.history_neighbors(texts, asked, visible), means)
        if retrieval.depth_region:
            counts = past.select("query_text", "search_loc", "item_id", "item_loc").distinct().groupBy("search_loc", "item_loc").agg(F.count("*").alias("n"))
            extra["dense_region"] = (region_list(centroids, counts, queries, items, retrieval.depth_region), retrieval.depth_region)
    # lists that the contract names but the configuration doesn't use are null columns
    used = retrieval.list_names()
    names = used + [n for n in (f.removeprefix("rank_") for f in BASE if f.startswith("rank_")) if n not in used]
    pool = fusion.candidate_pool(lists(queries, items, centers, retrieval) | extra, retrieval.rrf_k, names)
    out = features.build_features(pool, queries, items, stats, stem=retrieval.bm25.stem).join(_more(items), "doc_id").join(queries.select("query_id", "view_id"), "query_id")
    out = dense.pair_similarity(out, queries, items.select(F.col("item_id").alias("doc_id"), "embedding"))
    if blocks.fields != "none":
        out = _field_scores(out, queries, items, blocks.fields)
    if blocks.geo != "none":
        out = history.geo_fallback(out.drop("dist_km"), stats, hist, VIEW)
        out = history.geo_damping(out) if blocks.damping else out
    if blocks.transitions != "none":
        share = history.corpus_location_share(items)
        out = history.transition_features(out, *history.transitions(past, share, VIEW), share, VIEW, blocks.alpha)
    if texts is not None and blocks.microcats != "none":
        near = microcats.history_neighbors(texts, asked, visible, need_microcat=True)
        out = microcats.microcat_features(out, *microcats.distribution(near, microcats.text_microcats(past, VIEW), blocks.microcats == "exact", VIEW))
    return _signal_features(out, queries, items, blocks, centroids if texts is not None else None, second)


def _signal_features(out: DataFrame, queries: DataFrame, items: DataFrame, blocks, centroids: DataFrame | None, second: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """The blocks of centroids, filters and the second encoder, each where it is on and its vectors are given."""
    if blocks.centroid and centroids is not None:
        out = signals.cosine_features(out, centroids, items, "nb_cos")
    if blocks.filters:
        wanted = queries.select("query_id", parse_filters(F.col("filters")).alias("_filters"))
        match = filter_match(F.col("_filters"), F.col("_params"))
        params = items.select(F.col("item_id").alias("doc_id"), F.col("params").alias("_params"))
        out = out.join(wanted, "query_id").join(params, "doc_id").withColumns({name: match[name] for name in FILTERS}).drop("_filters", "_params")
    if blocks.second_encoder and second is not None:
        out = signals.cosine_features(out, second[0], second[1], "enc2_sim").withColumnRenamed("enc2_sim_rank", "enc2_rank")
    return out


def _field_scores(out: DataFrame, queries: DataFrame, items: DataFrame, mode: str) -> DataFrame:
    normal = items.select("item_id", *(normalize_text(F.col(c)).alias(c) for c in ("title", "params", "description")))
    asked = queries.select("query_id", F.col("query_text").alias("text"), normalize_text(F.col("filters")).alias("filters"))
    scored = lexical.field_scores(normal, asked, out.select("query_id", "doc_id"), {f"bm25_{c}": c for c in ("title", "params", "description")}, lexical.BM25Config(stem=True, stop_words=True), {"bm25_filters": ("filters", "params")} if mode == "filters" else {})
    return out.join(scored, ["query_id", "doc_id"])


def _more(items: DataFrame) -> DataFrame:
    """Item attributes that are features as they are."""
    flag = lambda c: F.col(c).cast("int")
    return items.select(F.col("item_id").alias("doc_id"), "rating", "reviews", flag("phone_hidden").alias("phone_hidden"), flag("message_forbidden").alias("message_forbidden"), F.length(F.coalesce("description", F.lit(""))).alias("description_chars"))


def answer(scored: DataFrame, queries: DataFrame, items: DataFrame, k: int = ranker.TOP_K, id_length: int = submission.ID_LENGTH, item_id: str = submission.ITEM_ID) -> DataFrame:
    """The answer of a scored frame; raises with the first violations if it isn't valid."""
    out = submission.answer_frame(ranker.select_top(scored, queries, k), k)
    wrong = submission.validate_answer(out, queries, items, k, id_length, item_id).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['query_id']}: {r['violation']}" for r in wrong))
    return out
