"""Queries on sources, sinks, caches, stores and small table operators: what was written is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import dense, encode, lexical, ranker, split, tables
from sieveline.plans.config import SearchConfig
from sieveline.plans.text_queries import CONTEXTS_SQL, NORMAL_SQL, contexts, hash_sql, part_sql
from sieveline.sources import io
from sieveline.sources.adapter import ITEMS_SQL, LOG_SQL, interactions, items, read


def _raw_log(spark: SparkSession, d: str) -> DataFrame:
    """The log in the raw columns of a training file."""
    own = items(spark, d)
    none = F.lit(None)
    listing = own.select(
        "item_id", F.col("title").alias("item_title_raw"), none.cast("string").alias("item_description_raw"), F.col("params").alias("item_infm_params_text"), F.col("category").alias("item_category_id"), F.col("microcat").alias("item_microcat_id"), F.col("price").alias("item_price"),
        none.cast("double").alias("item_rating"), none.cast("long").alias("item_rating_reviews_count"), F.col("loc").alias("item_location_id"), F.col("lat").alias("item_latitude"), F.col("lon").alias("item_longitude"), F.lit(False).alias("item_is_phone_hidden"), F.lit(True).alias("item_is_message_forbidden"),
    )
    log = interactions(spark, d).select(F.concat(F.lit("  "), F.upper("query_text")).alias("search_query"), F.col("search_loc").alias("search_location_id"), F.lit(False).alias("search_is_delivery_search"), F.nullif("filters", F.lit("")).alias("search_infm_params_text"), F.col("category").alias("search_category"), "item_id")
    return log.join(listing, "item_id")


def train_log(spark, d):
    """A written training file, scanned with its queries prepared."""
    path = io.scratch(spark, "train")
    io.write_table(_raw_log(spark, d), path)
    return io.load_train(spark, path).groupBy("query_text", "search_infm_params_text").agg(F.count("*").alias("n"))


def named_corpus(spark, d):
    root = io.scratch(spark, "corpora")
    io.write_table(split.build_corpus(_raw_log(spark, d).select(io.ITEM_COLS)), f"{root}/{io.CORPORA['split']}")
    return io.load_corpus(spark, root, "split").select("item_id", "item_title_raw", "item_location_id", F.round("item_price", 6).alias("item_price"))


def eval_bundle(spark, d):
    """The corpus, the development queries and the items of training contexts, counted."""
    root = io.scratch(spark, "bundle")
    own = contexts(spark, d).withColumn("part", split.part_of(F.col("query_text")))
    io.write_table(items(spark, d).withColumnsRenamed({"title": "item_title_raw"}).select(*(F.col(c) if c in ("item_id", "item_title_raw") else F.lit(None).cast("string").alias(c) for c in io.ITEM_COLS)), f"{root}/{io.CORPORA['split']}")
    io.write_table(own.where("part = 'train'"), f"{root}/contexts_train.parquet")
    io.write_table(own.where("part = 'dev'"), f"{root}/eval_dev.parquet")
    corpus, queries, seen = io.load_eval(spark, root, "dev")
    parts = {"corpus": corpus, "queries": queries, "seen": seen}
    return spark.createDataFrame([(k, v.count()) for k, v in parts.items()], "name string, n long")


def partitioned_table(spark, d):
    """Contexts written by part; a part is read without the others."""
    path = io.scratch(spark, "contexts")
    io.write_table(contexts(spark, d).withColumn("part", split.part_of(F.col("query_text"))), path, ["part"])
    return spark.read.parquet(path).where("part = 'dev'").select("query_id", "part", F.size("item_ids").alias("n_items"))


def answer_file(spark, d):
    """An answer written as CSV and read again; an existing file is refused."""
    path = io.scratch(spark, "answer")
    answer = contexts(spark, d).select("query_id", F.array_join(F.transform("item_ids", lambda x: x.cast("string")), " ").alias("answer"))
    io.write_answer(answer, path)
    if not io.same_rows(io.read_answer(spark, path), answer):
        raise ValueError("the answer changed on its way")
    return io.read_answer(spark, path)


def json_file(spark, d):
    """The contract through a JSON file: each feature at its place."""
    path = f"{io.scratch(spark, 'contract')}.json"
    io.write_json(spark, SearchConfig().contract(), path)
    return spark.createDataFrame(list(enumerate(io.read_json(spark, path)["features"])), "place long, feature string")


def _passages(spark, d) -> DataFrame:
    return items(spark, d).select(F.col("item_id").alias("id"), encode.passage_text(F.col("title"), F.col("params"), F.col("category")).alias("text"))


def _encoded(df: DataFrame) -> DataFrame:
    return encode.encode(df, "id" if "id" in df.columns else "text", "text", encode.load_model(encode.EncoderConfig()))


def _places(df: DataFrame, *keys: str) -> DataFrame:
    """The largest component of each vector, and its sum."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return df.select(*keys, F.round(F.array_max(x), 4).alias("largest"), F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 3).alias("total"))


def embedding_store(spark, d):
    """Vectors from a store that is filled in chunks, for one corpus and model."""
    path, texts = io.scratch(spark, "vectors"), _passages(spark, d)
    tag = encode.EncoderConfig().passage_tag()
    io.save_embeddings(texts, path, tag, _encoded, 4)
    return _places(io.load_embeddings(spark, path, texts, tag), "id")


def vector_cache(spark, d):
    """Vectors of texts, half of which the cache holds already."""
    path, texts = io.scratch(spark, "texts"), _passages(spark, d).select("id", F.substring("text", 10, 200).alias("text"))
    tag = encode.EncoderConfig().tag()
    io.text_vectors(texts.where("id % 2 = 0"), path, tag, _encoded)
    return _places(texts.join(io.text_vectors(texts, path, tag, _encoded), "text"), "id")


def cached_run(spark, d):
    """A list that is computed once for the same queries and anew for others."""
    path, calls = io.scratch(spark, "run"), []

    def compute(queries: DataFrame):
        def run() -> DataFrame:
            calls.append(1)
            v = read(spark, d, "embeddings")
            return dense.search(v.select(F.col("vec_id").alias("doc_id"), "embedding"), queries, 3)

        return run

    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    few, more = v.where("query_id % 200 = 0"), v.where("query_id % 100 = 0")
    for queries in (few, few, more):
        found = io.cached(spark, path, queries, compute(queries))
    if len(calls) != 2:
        raise ValueError(f"computed {len(calls)} times")
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def stored_model(spark, d):
    """A fitted pipeline stored with its contract, loaded, checked and applied: the same scores as before."""
    own = items(spark, d).select(F.col("item_id").alias("query_id"), F.col("item_id").alias("doc_id"), "price", F.col("loc").cast("double").alias("loc"), (F.col("loc") % 2).alias("label"))
    names = ["price", "loc"]
    model = ranker.train_gbt(own, names, trees=3, depth=2)
    path, contract = io.scratch(spark, "ranker"), SearchConfig().contract()
    io.save_model(spark, model, contract, path)
    loaded, held = io.load_model(spark, path)
    if held != contract:
        raise ValueError("the contract changed")
    before, after = (ranker.predict_gbt(m, own, names).select("doc_id", "score") for m in (model, loaded))
    return before.join(after.withColumnRenamed("score", "again"), "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") != F.col("again")).alias("changed"))


def row_numbers(spark, d):
    """Every text's place in alphabetical order."""
    return tables.row_index(interactions(spark, d).select("query_text").distinct(), ["query_text"], "place", io.scratch(spark, "numbered"))


def hash_sample(spark, d):
    return tables.sample_rows(items(spark, d).select("item_id", "title"), "item_id", 100)


def joined_parts(spark, d):
    """The log with its texts' parts, each text having one."""
    log = interactions(spark, d)
    return tables.join_unique(log, split.assign_parts(log), ["query_text"]).groupBy("part").agg(F.count("*").alias("n"))


def disjoint_parts(spark, d):
    parts = split.assign_parts(interactions(spark, d))
    both = parts.unionByName(parts.where("part = 'dev'").withColumn("part", F.lit("test")))
    return spark.createDataFrame([("as assigned", split.disjoint(parts)), ("with a text in two", split.disjoint(both))], "parts string, is_disjoint boolean")


def query_texts(spark, d):
    """What BM25 and the encoder are asked."""
    text, filters = F.col("query_text"), F.nullif("filters", F.lit(""))
    return contexts(spark, d).select("query_id", lexical.query_text(text, F.col("filters"), True).alias("lexical"), encode.query_text(text, filters).alias("dense"), encode.query_text(text, filters, False).alias("dense_plain"))


_MD5 = "('0x' || substr(md5(g), 1, 8))::ubigint"


def _encoder_sql(source: str) -> str:
    """CTEs ending in enc(id, largest, total) for ``source``(id, text): the hashed encoder of 64 dimensions."""
    return f"""words as (select id, unnest(string_split_regex(trim(lower(text)), '\\s+')) w from {source}), grams as (select id, w g from words where w <> '' union all select id, substr(w, k, 3) from words, range(1, 200) t(k) where k + 2 <= length(w)),
cells as (select id, {_MD5} % 64 pos, sum(case when {_MD5} >= 2147483648 then 1 else -1 end)::double v from grams group by 1, 2), norms as (select id, sqrt(sum(v * v)) n, count(*) c, max(v) m, sum(v) t from cells group by 1),
enc as (select id, round(case when c < 64 then greatest(m, 0) else m end / greatest(n, 1e-12), 4) largest, round(t / greatest(n, 1e-12), 3) total from norms)"""


_PASSAGES = "passages as (select item_id id, 'passage: ' || title || chr(10) || substr(params, 1, 500) || chr(10) || category as text from items)"
_NAMES = ", ".join(f"'{f}'" for f in SearchConfig().features())

QUERIES = {
    "train_log": (train_log, f"with {LOG_SQL} select {NORMAL_SQL.format('query_text')} query_text, filters search_infm_params_text, count(*) n from log group by 1, 2"),
    "named_corpus": (named_corpus, f"with {ITEMS_SQL} select item_id, title item_title_raw, loc item_location_id, round(price, 6) item_price from items where item_id in (select l_partkey from lineitem)"),
    "eval_bundle": (eval_bundle, f"with {CONTEXTS_SQL}, {ITEMS_SQL} select 'corpus' as name, count(*) n from items union all select 'queries', count(*) from contexts where {part_sql('query_text')} = 'dev' union all select 'seen', count(distinct i) from (select unnest(item_ids) i from contexts where {part_sql('query_text')} = 'train')"),
    "partitioned_table": (partitioned_table, f"with {CONTEXTS_SQL} select query_id, 'dev' part, len(item_ids)::int n_items from contexts where {part_sql('query_text')} = 'dev'"),
    "answer_file": (answer_file, f"with {CONTEXTS_SQL} select query_id, array_to_string(item_ids, ' ') answer from contexts"),
    "feature_contract": (json_file, f"select generate_subscripts([{_NAMES}], 1) - 1 place, unnest([{_NAMES}]) feature"),
    "embedding_store": (embedding_store, f"with {ITEMS_SQL}, {_PASSAGES}, {_encoder_sql('passages')} select * from enc"),
    "vector_cache": (vector_cache, f"with {ITEMS_SQL}, {_PASSAGES}, cut as (select id, substr(text, 10, 200) as text from passages), {_encoder_sql('cut')} select * from enc"),
    "cached_run": (cached_run, "with s as (select q.vec_id query_id, p.vec_id doc_id, list_inner_product(q.embedding::double[], p.embedding::double[]) score from embeddings q, embeddings p where q.vec_id % 100 = 0) select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank, round(score, 6) score from s qualify rank <= 3"),
    "stored_model": (stored_model, f"with {ITEMS_SQL} select count(*) n, 0::bigint changed from items"),
    "row_numbers": (row_numbers, f"with {LOG_SQL} select query_text, row_number() over (order by query_text) - 1 place from (select distinct query_text from log)"),
    "hash_sample": (hash_sample, f"with {ITEMS_SQL} select item_id, title from items order by {hash_sql('item_id')}, item_id limit 100"),
    "joined_parts": (joined_parts, f"with {LOG_SQL} select {part_sql('query_text')} part, count(*) n from log group by 1"),
    "disjoint_parts": (disjoint_parts, "select 'as assigned' parts, true is_disjoint union all select 'with a text in two', false"),
    "query_texts": (query_texts, f"with {CONTEXTS_SQL} select query_id, query_text || ' ' || {NORMAL_SQL.format('filters')} lexical, 'query: ' || concat_ws('. ', query_text, nullif(filters, '')) dense, 'query: ' || query_text dense_plain from contexts"),
}
