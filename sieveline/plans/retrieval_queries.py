"""Queries on ranked lists: lexical, dense, local, radius, fused; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions.stem import stem, stem_set
from sieveline.functions.text import overlap, token_set
from sieveline.operators import dense, fusion, geo, lexical
from sieveline.sources.adapter import ITEMS_SQL, items, read

K = 10
TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"


def _texts(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("query_loc"))
    return docs, queries


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def bm25_global_topk(spark, d):
    docs, queries = _texts(spark, d)
    return _rounded(lexical.search(lexical.index(docs), queries, K), "score")


def bm25_local_topk(spark, d):
    docs, queries = _texts(spark, d)
    return _rounded(lexical.search_local(lexical.index(docs), queries, K, "query_loc", docs.select("doc_id", F.col("source").alias("loc"))), "score")


def bm25_group_topk(spark, d):
    """Each query may use the documents of its language's group: those whose id has its remainder."""
    docs, queries = _texts(spark, d)
    allowed = queries.select("query_id", (F.col("query_id") % 4).alias("m")).join(docs.select("doc_id", (F.col("doc_id") % 4).alias("m")), "m").select("query_id", "doc_id")
    return _rounded(lexical.search_groups(lexical.index(docs), queries, K, allowed), "score")


def _local_pairs(docs, queries):
    """Each query and every document of its own place."""
    return queries.select("query_id", F.col("query_loc").alias("source")).join(docs.select("doc_id", "source"), "source").select("query_id", "doc_id")


def bm25_pair_scores(spark, d):
    docs, queries = _texts(spark, d)
    return _rounded(lexical.pair_scores(lexical.index(docs), queries, _local_pairs(docs, queries)), "score")


# Inflected words, particles among them, of which the texts of the stemmed queries are made.
RUSSIAN = "ремонт ремонта холодильников холодильник и стрижка стрижки для кухни кухня окна окон на дверей двери квартира квартиры уборка уборку не массаж массажа доставка доставкой".split()


def _russian(item_id, steps):
    words = F.array(*map(F.lit, RUSSIAN))
    return F.concat_ws(" ", *(F.element_at(words, ((item_id * a + b) % len(RUSSIAN) + 1).cast("int")) for a, b in steps))


DOC_STEPS, QUERY_STEPS = [(1, 0), (7, 3), (5, 1), (11, 4), (1, 4)], [(13, 1), (3, 5), (1, 2)]


def _russian_texts(spark, d):
    own = items(spark, d).select("item_id", "loc").persist()
    k = F.col("item_id")
    return own.select(k.alias("doc_id"), "loc", _russian(k, DOC_STEPS).alias("text")), own.where("item_id % 100 = 0").select(k.alias("query_id"), F.col("loc").alias("query_loc"), _russian(k, QUERY_STEPS).alias("text"))


def bm25_stemmed_topk(spark, d):
    """Stems of Russian words, particles left out."""
    docs, queries = _russian_texts(spark, d)
    return _rounded(lexical.search(lexical.index(docs, config=lexical.BM25Config(stem=True, stop_words=True)), queries, K), "score")


def stemmed_overlap(spark, d):
    docs, queries = _russian_texts(spark, d)
    pairs = queries.join(docs.select("doc_id", "loc", F.col("text").alias("title")), F.col("query_loc") == F.col("loc"))
    return pairs.select("query_id", "doc_id", F.round(overlap(stem_set(token_set(F.col("text"))), stem_set(token_set(F.col("title")))), 6).alias("overlap"))


def field_scores(spark, d):
    """Items whose id is divisible by 100 as queries, against all items of their place; filters against parameters too."""
    own = items(spark, d).select("item_id", "title", "params", "category", "loc").persist()
    queries = own.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("title").alias("text"), F.col("category").alias("filters"), "loc")
    return lexical.field_scores_within(own, queries, "loc", {"bm25_title": "title", "bm25_params": "params"}, asked={"bm25_filters": ("filters", "params")}, digits=6)


def _vectors(spark, d):
    """All vectors, and as queries those whose id is divisible by 100."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return v.select(F.col("vec_id").alias("doc_id"), "embedding", "label"), queries


def dense_global_topk(spark, d):
    docs, queries = _vectors(spark, d)
    return _rounded(dense.search(docs, queries, K), "score")


def dense_local_topk(spark, d):
    docs, queries = _vectors(spark, d)
    return _rounded(dense.search(docs, queries, K, group="label"), "score")


def dense_pair_similarity(spark, d):
    docs, queries = _vectors(spark, d)
    pairs = queries.select("query_id", "label").join(docs.select("doc_id", "label"), "label").select("query_id", "doc_id")
    return _rounded(dense.pair_similarity(pairs, queries, docs), "dense_sim")


def _radius(spark, d, km=120.0):
    own = items(spark, d).select(F.col("item_id").alias("doc_id"), "lat", "lon", "loc", "price")
    centers = own.where("doc_id % 100 = 0").select(F.col("doc_id").alias("center_id"), (F.col("lat") + 0.3).alias("lat"), (F.col("lon") - 0.3).alias("lon"))
    return geo.radius_join(centers, own, km), own


def radius_join(spark, d):
    return _rounded(_radius(spark, d)[0], "dist_km")


def radius_topk(spark, d):
    near, own = _radius(spark, d)
    scored = near.join(own.select("doc_id", "price"), "doc_id").select(F.col("center_id").alias("query_id"), "doc_id", F.col("price").alias("score"))
    return _rounded(lexical.top_k(scored, K), "score")


def geo_rerank(spark, d):
    docs, queries = _vectors(spark, d)
    hits = dense.search(docs, queries, 20)
    placed = hits.join(docs.select("doc_id", F.col("label").alias("i_loc")), "doc_id").join(queries.select("query_id", F.col("label").alias("q_loc")), "query_id")
    out = fusion.geo_rerank(placed, F.col("q_loc"), F.col("i_loc"), 0.6, 0.1)
    return _rounded(out.select("query_id", "doc_id", "rank", "score"), "score")


def _lists(spark, d):
    docs, queries = _vectors(spark, d)
    far = dense.search(docs, queries, 30)
    near = dense.search(docs, queries, 20, group="label")
    return {"dense_global": (far, 25), "dense_local": (near, 15)}, queries


def rrf_fused(spark, d):
    lists, _ = _lists(spark, d)
    return _rounded(fusion.rrf_fuse([h for h, _ in lists.values()]), "rrf")


def rrf_pool(spark, d):
    lists, _ = _lists(spark, d)
    pool = fusion.candidate_pool(lists, names=["dense_global", "dense_local", "dense_radius"])
    return _rounded(pool, "rrf", "score_dense_global", "score_dense_local")


def pool_size_stats(spark, d):
    lists, _ = _lists(spark, d)
    return _rounded(fusion.pool_size_stats(fusion.candidate_pool(lists)), "mean_size", "p95_size")


def pool_rows(spark, d):
    lists, queries = _lists(spark, d)
    got = fusion.pool_rows(fusion.candidate_pool(lists), queries)
    return got.select("query_id", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), " ").alias("ids"))


def token_overlap(spark, d):
    docs, queries = _texts(spark, d)
    q = queries.select("query_id", F.col("query_loc").alias("source"), token_set(F.col("text")).alias("q"))
    t = docs.select("doc_id", "source", token_set(F.col("text")).alias("t"))
    return q.join(t, "source").select("query_id", "doc_id", F.round(overlap(F.col("q"), F.col("t")), 6).alias("overlap"))


def _bm25_sql(docs: str, queries: str, stems: bool = False) -> str:
    """CTEs ending in ``scored``(query_id, doc_id, score) for tables with (doc_id, text) and (query_id, text); ``stems``: by the tables stems and stops."""
    term = f"unnest({TOKENS.format('text')}) term"
    terms = lambda key, table: f"(select {key}, stem term from (select {key}, {term} from {table}) join stems on term = word where term not in (select word from stops))" if stems else f"(select {key}, {term} from {table})"
    return f"""terms as {terms('doc_id', docs)},
tf as (select doc_id, term, count(*) tf from terms group by 1, 2), dl as (select doc_id, sum(tf) dl from tf group by 1), df as (select term, count(*) df from tf group by 1),
n as (select (select count(*) from {docs}) n, (select sum(dl) from dl) total),
w as (select doc_id, term, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl * n / total)) weight from tf join df using (term) join dl using (doc_id), n),
qt as (select query_id, term, count(*) c from {terms('query_id', queries)} group by 1, 2),
scored as (select query_id, doc_id, sum(weight * c) score from w join qt using (term) group by 1, 2)"""


def _russian_sql(steps) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in RUSSIAN) + "]"
    return "concat_ws(' ', " + ", ".join(f"{words}[(item_id * {a} + {b}) % {len(RUSSIAN)} + 1]" for a, b in steps) + ")"


_STEMS = "stems as (select * from (values " + ", ".join(f"('{w}', '{stem(w)}')" for w in RUSSIAN) + ") t(word, stem)), stops as (select unnest([" + ", ".join(f"'{w}'" for w in RUSSIAN if w in lexical.STOP_WORDS) + "]) word)"
_RUSSIAN = f"{ITEMS_SQL}, {_STEMS}, docs as (select item_id doc_id, loc, {_russian_sql(DOC_STEPS)} as text from items), queries as (select item_id query_id, loc query_loc, {_russian_sql(QUERY_STEPS)} as text from items where item_id % 100 = 0)"
_TEXTS = "docs as (select doc_id, text, source from documents), queries as (select item_id query_id, text, 'src' || (item_id % 20) query_loc from benchmark)"
_CUT = "row_number() over (partition by query_id order by round(score, 9) desc, doc_id)"
_TOP = f"select query_id, doc_id, round(score, 6) score, {_CUT} as rank from {{}} qualify {_CUT} <= {K}"
_VEC = "docs as (select vec_id doc_id, embedding, label from embeddings), queries as (select vec_id query_id, embedding, label from embeddings where vec_id % 100 = 0)"
_DOT = "list_inner_product(q.embedding::double[], d.embedding::double[])"
_ALL = f"{_VEC}, pairs as (select query_id, doc_id, q.label q_loc, d.label i_loc, {_DOT} score from queries q, docs d)"
_KM = "2 * 6371.0e0 * asin(least(1.0e0, sqrt(pow(sin(radians(i.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(i.lat)) * pow(sin(radians(i.lon - c.lon) / 2), 2))))"
_NEAR = f"{ITEMS_SQL}, centers as (select item_id center_id, lat + 0.3e0 lat, lon - 0.3e0 lon from items where item_id % 100 = 0), near as (select center_id, item_id doc_id, price, {_KM} dist_km from centers c, items i where {_KM} <= 120)"
_LISTS = f"""{_ALL}, far as (select query_id, doc_id, score, {_CUT} as rank from pairs qualify {_CUT} <= 30), near as (select query_id, doc_id, score, {_CUT} as rank from pairs where q_loc = i_loc qualify {_CUT} <= 20)"""
_POOL = f"""{_LISTS}, a as (select * from far where rank <= 25), b as (select * from near where rank <= 15),
pool0 as (select query_id, doc_id, a.rank rank_dense_global, a.score score_dense_global, b.rank rank_dense_local, b.score score_dense_local,
  round(coalesce(1.0e0 / (60 + a.rank), 0) + coalesce(1.0e0 / (60 + b.rank), 0), 12) rrf, (a.rank is not null)::int + (b.rank is not null)::int n_lists from a full join b using (query_id, doc_id)),
pool as (select *, row_number() over (partition by query_id order by rrf desc, doc_id) rrf_rank from pool0)"""

QUERIES = {
    "bm25_global_topk": (bm25_global_topk, f"with {_TEXTS}, {_bm25_sql('docs', 'queries')} {_TOP.format('scored')}"),
    "bm25_local_topk": (bm25_local_topk, f"with {_TEXTS}, {_bm25_sql('docs', 'queries')}, own as (select s.* from scored s join docs using (doc_id) join queries using (query_id) where source = query_loc) {_TOP.format('own')}"),
    "bm25_group_topk": (bm25_group_topk, f"with {_TEXTS}, {_bm25_sql('docs', 'queries')}, own as (select * from scored where query_id % 4 = doc_id % 4) {_TOP.format('own')}"),
    "bm25_pair_scores": (bm25_pair_scores, f"with {_TEXTS}, {_bm25_sql('docs', 'queries')} select query_id, p.doc_id, round(coalesce(score, 0), 6) score from queries join docs p on source = query_loc left join scored using (query_id, doc_id)"),
    "bm25_stemmed_topk": (bm25_stemmed_topk, f"with {_RUSSIAN}, {_bm25_sql('docs', 'queries', True)} {_TOP.format('scored')}"),
    "stemmed_overlap": (
        stemmed_overlap,
        f"""with {_RUSSIAN}, qs as (select distinct query_id, query_loc, stem from (select query_id, query_loc, unnest({TOKENS.format('text')}) word from queries) join stems using (word)), ds as (select distinct doc_id, loc, stem from (select doc_id, loc, unnest({TOKENS.format('text')}) word from docs) join stems using (word)),
nq as (select query_id, count(*) n from qs group by 1), hit as (select query_id, doc_id, count(*) h from qs join ds on loc = query_loc and qs.stem = ds.stem group by 1, 2)
select query_id, doc_id, round(coalesce(h, 0) / n::double, 6) overlap from queries join docs on loc = query_loc join nq using (query_id) left join hit using (query_id, doc_id)""",
    ),
    "field_scores": (
        field_scores,
        f"""with {ITEMS_SQL}, t as (select item_id doc_id, title as text from items), p as (select item_id doc_id, params as text from items), queries as (select item_id query_id, title as text, loc from items where item_id % 100 = 0), asked as (select item_id query_id, category as text from items where item_id % 100 = 0),
a as (with {_bm25_sql('t', 'queries')} select * from scored), b as (with {_bm25_sql('p', 'queries')} select * from scored), c as (with {_bm25_sql('p', 'asked')} select * from scored)
select query_id, r.item_id doc_id, round(coalesce(a.score, 0), 6) bm25_title, round(coalesce(b.score, 0), 6) bm25_params, round(coalesce(c.score, 0), 6) bm25_filters
from queries q join items r on q.loc = r.loc left join a on a.query_id = q.query_id and a.doc_id = r.item_id left join b on b.query_id = q.query_id and b.doc_id = r.item_id left join c on c.query_id = q.query_id and c.doc_id = r.item_id""".replace("select query_id, r.item_id", "select q.query_id, r.item_id"),
    ),
    "dense_global_topk": (dense_global_topk, f"with {_ALL} {_TOP.format('pairs')}"),
    "dense_local_topk": (dense_local_topk, f"with {_ALL}, own as (select * from pairs where q_loc = i_loc) {_TOP.format('own')}"),
    "dense_pair_similarity": (dense_pair_similarity, f"with {_ALL} select query_id, doc_id, round(score, 6) dense_sim from pairs where q_loc = i_loc"),
    "radius_join": (radius_join, f"with {_NEAR} select center_id, doc_id, round(dist_km, 6) dist_km from near"),
    "radius_topk": (radius_topk, f"with {_NEAR}, own as (select center_id query_id, doc_id, price score from near) {_TOP.format('own')}"),
    "geo_rerank": (
        geo_rerank,
        f"""with {_ALL}, top as (select *, {_CUT} as rank from pairs qualify {_CUT} <= 20), own as (select query_id, doc_id, case when q_loc = i_loc then score else score * 0.6e0 - 0.1e0 end score from top)
select query_id, doc_id, round(score, 6) score, {_CUT} as rank from own""",
    ),
    "rrf_fused": (rrf_fused, f"with {_LISTS}, f as (select query_id, doc_id, round(sum(1.0e0 / (60 + rank)), 12) rrf from (select * from far union all select * from near) group by 1, 2) select query_id, doc_id, round(rrf, 6) rrf, row_number() over (partition by query_id order by f.rrf desc, doc_id) as rank from f"),
    "rrf_pool": (rrf_pool, f"with {_POOL} select query_id, doc_id, rank_dense_global, round(score_dense_global, 6) score_dense_global, rank_dense_local, round(score_dense_local, 6) score_dense_local, cast(null as int) rank_dense_radius, cast(null as double) score_dense_radius, round(rrf, 6) rrf, n_lists, rrf_rank from pool"),
    "pool_size_stats": (pool_size_stats, f"with {_POOL}, s as (select query_id, count(*) n from pool group by 1) select count(*) queries, round(avg(n), 6) mean_size, round(quantile_cont(n::double, 0.95), 6) p95_size from s"),
    "pool_rows": (pool_rows, f"with {_POOL} select query_id, string_agg(doc_id::varchar, ' ' order by rrf_rank) ids from pool group by 1"),
    "token_overlap": (token_overlap, f"with {_TEXTS}, q as (select query_id, query_loc, list_distinct({TOKENS.format('text')}) q from queries), t as (select doc_id, source, list_distinct({TOKENS.format('text')}) t from docs) select query_id, doc_id, round(len(list_intersect(q, t)) / len(q)::double, 6) overlap from q join t on source = query_loc"),
}
