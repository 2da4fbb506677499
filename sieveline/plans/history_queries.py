"""Queries on places, history, microcategories and signals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import dense, geo, history, microcats, signals
from sieveline.plans.text_queries import CONTEXTS_SQL, FOLD_SQL, contexts
from sieveline.sources.adapter import ITEMS_SQL, items, read

HOLD = "substr(query_text, 1, 1) < 'd'"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _pairs(spark, d) -> DataFrame:
    return history.history_pairs(contexts(spark, d), items(spark, d))


def location_stats(spark, d):
    return _rounded(geo.location_stats(items(spark, d)), "lat", "lon")


def location_centers(spark, d):
    return _rounded(geo.location_centers(_pairs(spark, d)), "lat", "lon", "spread_km")


def query_centers(spark, d):
    """Only half of the places count as the corpus', so that the fallback is used; a third of the rest has no history."""
    pairs = _pairs(spark, d)
    stats = geo.location_stats(items(spark, d)).where("loc % 2 = 0")
    found = geo.query_centers(pairs, stats, geo.location_centers(pairs.where("search_loc % 3 <> 0")))
    return _rounded(found, "lat", "lon")


def history_pair_counts(spark, d):
    return _pairs(spark, d).groupBy("fold", "item_loc").agg(F.count("*").alias("n"), F.countDistinct("query_text").alias("texts"))


def crossfit_history(spark, d):
    """For each view the queries that it judges and the pairs that it may see."""
    own = contexts(spark, d)
    holdout = own.where(HOLD).select("query_text").distinct()
    queries = history.crossfit_queries(own, holdout).groupBy("view_id").agg(F.count("*").alias("queries"))
    pairs = history.crossfit_pairs(_pairs(spark, d), holdout).groupBy("view_id").agg(F.count("*").alias("pairs"), F.countDistinct("query_text").alias("texts"))
    return queries.join(pairs, "view_id", "full_outer").select("view_id", F.coalesce("queries", F.lit(0)).alias("queries"), F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("texts", F.lit(0)).alias("texts"))


def location_share(spark, d):
    return _rounded(history.corpus_location_share(items(spark, d)), "share")


def transitions(spark, d):
    share = history.corpus_location_share(items(spark, d)).where("loc % 3 <> 1")
    counts, totals = history.transitions(_pairs(spark, d), share)
    return _rounded(counts.join(totals, "search_loc"), "outside_share")


def _frame(spark, d) -> DataFrame:
    """Every item of the log and the places that it was searched from."""
    return _pairs(spark, d).select("search_loc", F.col("item_id").alias("doc_id"), "item_loc", "microcat", "lat", "lon").distinct()


def transition_features(spark, d):
    share = history.corpus_location_share(items(spark, d)).where("loc % 3 <> 1")
    counts, totals = history.transitions(_pairs(spark, d).where("search_loc % 5 <> 0"), share)
    out = history.transition_features(_frame(spark, d), counts, totals, share)
    return _rounded(out.drop("microcat", "lat", "lon"), "trans_prob", "trans_lift", "trans_outside_share")


def _fallback(spark, d) -> DataFrame:
    stats = geo.location_stats(items(spark, d)).where("loc % 2 = 0")
    centers = geo.location_centers(_pairs(spark, d).where("search_loc % 3 <> 0"))
    return history.geo_fallback(_frame(spark, d), stats, centers)


def geo_fallback(spark, d):
    return _rounded(_fallback(spark, d).drop("microcat", "lat", "lon"), "dist_km", "hist_dist_km", "hist_spread_km")


def geo_damping(spark, d):
    return _rounded(history.geo_damping(_fallback(spark, d)).select("search_loc", "doc_id", "geo_unreliable", "log_dist_clean"), "log_dist_clean")


def crossfit_transitions(spark, d):
    """Transition counts of each view in one keyed plan."""
    own = contexts(spark, d)
    holdout = own.where(HOLD).select("query_text").distinct()
    pairs = history.crossfit_pairs(_pairs(spark, d), holdout)
    share = history.corpus_location_share(items(spark, d))
    counts, totals = history.transitions(pairs, share, ("view_id",))
    return _rounded(totals, "outside_share").join(counts.groupBy("view_id", "search_loc").agg(F.max("n").alias("most")), ["view_id", "search_loc"])


def text_microcats(spark, d):
    return _rounded(microcats.text_microcats(_pairs(spark, d)), "share")


def _neighbors(spark, d, need_microcat):
    """Vectors as past texts in five folds. The queries, vectors whose id is divisible by 100, are each in a
    view that must not see one fold's texts; a text's choices have microcategories, but some have none."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    name = F.concat(F.lit("t"), "vec_id")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.expr("cast(vec_id div 100 % 5 as int)").alias("view_id"))
    choices = v.select(name.alias("query_text"), (F.col("vec_id") % 5).cast("int").alias("fold"), F.explode(F.array(F.when(F.col("vec_id") % 3 > 0, (F.col("vec_id") % 7).cast("string")), F.when(F.col("vec_id") % 3 > 0, F.col("label").cast("string")))).alias("microcat"))
    seen = history.crossfit_pairs(choices, choices.limit(0).select("query_text"))
    near = microcats.history_neighbors(v.select(name.alias("query_text"), "embedding"), queries, seen, need_microcat=need_microcat)
    return near, seen, v, queries


def _microcats(spark, d, exact):
    """For each query the microcategories of its 20 nearest items."""
    near, seen, v, queries = _neighbors(spark, d, True)
    prob, per_query = microcats.distribution(near, microcats.text_microcats(seen, ("view_id",)), exact, ("view_id",))
    items = v.select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("microcat"))
    frame = dense.search(items, queries, 20).select("query_id", "doc_id").join(items.select("doc_id", "microcat"), "doc_id")
    return _rounded(microcats.microcat_features(frame, prob, per_query), "mc_prob", "mc_ratio", "mc_entropy", "mc_top_sim")


def neighbor_microcats(spark, d):
    return _microcats(spark, d, False)


def exact_microcats(spark, d):
    return _microcats(spark, d, True)


def neighbor_centroid_cos(spark, d):
    """A text's choices are its own vector's item and the next; candidates are each query's 20 nearest items."""
    near, _, v, queries = _neighbors(spark, d, False)
    own = v.select(F.col("vec_id").alias("item_id"), "embedding")
    chosen = v.select(F.concat(F.lit("t"), "vec_id").alias("query_text"), F.explode(F.array("vec_id", F.col("vec_id") + 1)).alias("item_id"))
    centroids = signals.neighbor_centroids(near, signals.text_item_means(chosen, own))
    frame = dense.search(own.withColumnRenamed("item_id", "doc_id"), queries, 20).select("query_id", "doc_id", F.col("rank").alias("rrf_rank"))
    return _rounded(signals.cosine_features(frame, centroids, own, "nb_cos"), "nb_cos")


def views_union(spark, d):
    """Choices of all views, each once."""
    holdout = contexts(spark, d).where(HOLD).select("query_text").distinct()
    return history.union_of_views(history.crossfit_pairs(_pairs(spark, d), holdout).select("view_id", "query_text", "item_id", "item_loc"))


def region_core(spark, d):
    counts = _pairs(spark, d).groupBy("search_loc", "item_loc").agg(F.count("*").alias("n"))
    return _rounded(signals.region_core(counts), "mass_before")


def region_hits(spark, d):
    """Dense hits among the items of a query's core places; labels stand for places."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    log = v.select((F.col("vec_id") % 5).cast("int").alias("search_loc"), F.col("label").alias("item_loc"))
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.expr("cast(vec_id div 100 % 5 as int)").alias("search_loc"))
    listings = v.select(F.col("vec_id").alias("item_id"), "embedding", F.col("label").alias("loc"))
    from sieveline.plans.search import region_list

    counts = log.groupBy("search_loc", "item_loc").agg(F.count("*").alias("n"))
    return _rounded(region_list(queries.select("query_id", "embedding"), counts, queries, listings, 5), "score")


_ROOT = "sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))"
_KM = f"2 * 6371.0e0 * asin(case when {_ROOT} > 1 then 1.0e0 else {_ROOT} end)"
_PAIRS = f"""{CONTEXTS_SQL}, {ITEMS_SQL}, chosen as (select query_text, search_loc, unnest(item_ids) item_id from contexts),
pairs as (select query_text, search_loc, item_id, loc item_loc, microcat, lat, lon, {FOLD_SQL} fold from chosen join items using (item_id))"""
_STATS = "stats as (select loc, median(lat) lat, median(lon) lon, count(*) n_items from items group by 1)"


def _centers(where: str = "true") -> str:
    return f"""c0 as (select search_loc, median(lat) clat, median(lon) clon, count(*) n_pairs, count(distinct item_id) n_items from pairs where {where} group by 1),
c1 as (select p.search_loc, median({_KM.format('clat', 'clon', 'lat', 'lon')}) spread_km from pairs p join c0 using (search_loc) group by 1),
centers as (select search_loc, clat lat, clon lon, n_pairs, n_items, spread_km from c0 join c1 using (search_loc))"""


_SHARE = "share0 as (select loc, count(*) / (select count(*) from items)::double share from items group by 1)"
_TRANS = """counts as (select search_loc, item_loc, count(*) n from {0} group by 1, 2), totals as (select search_loc, coalesce(sum(n) filter (where s.loc is not null), 0)::bigint support,
  count(s.loc) targets, sum(case when s.loc is null then n else 0 end) / sum(n)::double outside_share from counts left join share s on s.loc = item_loc group by 1)"""
_FRAME = "frame as (select distinct search_loc, item_id doc_id, item_loc, lat, lon from pairs)"
_VIEWS = f"""hold as (select distinct query_text from contexts where {HOLD}), vq as (select *, case when query_text in (select query_text from hold) then 5 else {FOLD_SQL} end view_id from contexts),
vp as (select p.*, v.view_id from pairs p, (select unnest(range(6)) view_id) v where v.view_id <> fold and query_text not in (select query_text from hold))"""
_FALL = f"""{_PAIRS}, {_STATS}, {_centers('search_loc % 3 <> 0')}, {_FRAME},
fall as (select f.search_loc, doc_id, item_loc, case when s.loc is not null then {_KM.format('s.lat', 's.lon', 'f.lat', 'f.lon')} else {_KM.format('c.lat', 'c.lon', 'f.lat', 'f.lon')} end dist_km, {_KM.format('c.lat', 'c.lon', 'f.lat', 'f.lon')} hist_dist_km,
  case when s.loc is not null then 0 when c.search_loc is not null then 1 else 2 end center_source, coalesce(n_pairs, 0) hist_pairs, spread_km hist_spread_km
  from frame f left join (select * from stats where loc % 2 = 0) s on s.loc = f.search_loc left join centers c on c.search_loc = f.search_loc)"""
_NB = """v as (select vec_id, embedding, label from embeddings), q as (select vec_id query_id, embedding, (vec_id // 100 % 5)::int view_id from v where vec_id % 100 = 0),
sims as (select query_id, view_id, p.vec_id, list_inner_product(q.embedding::double[], p.embedding::double[]) score from q, v p where p.vec_id % 5 <> view_id and {}),
nb as (select query_id, 't' || vec_id query_text, round(score, 9) score from sims qualify row_number() over (partition by query_id order by round(score, 9) desc, 't' || vec_id) <= 40)"""


def _mc_sql(weight: str) -> str:
    return f"""with {_NB.format('p.vec_id % 3 > 0')}, choices as (select 't' || vec_id query_text, unnest([(vec_id % 7)::varchar, label::varchar]) microcat from v where vec_id % 3 > 0), cc as (select query_text, microcat, count(*) n from choices group by 1, 2),
shares as (select query_text, microcat, n / sum(n) over (partition by query_text) share from cc), top as (select query_id, max(score) mc_top_sim from nb group by 1),
raw as (select nb.*, {weight} r from nb join top using (query_id)), w as (select *, r / sum(r) over (partition by query_id) w from raw),
prob as (select query_id, microcat, sum(w * share) mc_prob from w join shares using (query_text) group by 1, 2),
per as (select query_id, max(mc_prob) mc_max, -sum(case when mc_prob > 0 then mc_prob * ln(mc_prob) else 0 end) mc_entropy from prob group by 1),
hits as (select query_id, p.vec_id doc_id, label::varchar microcat, row_number() over (partition by query_id order by round(list_inner_product(q.embedding::double[], p.embedding::double[]), 9) desc, p.vec_id) rk from q, v p qualify rk <= 20),
frame as (select query_id, doc_id, microcat from hits)
select query_id, doc_id, microcat, round(coalesce(mc_prob, 0), 6) mc_prob, round(coalesce(mc_prob, 0) / mc_max, 6) mc_ratio, round(mc_entropy, 6) mc_entropy, round(mc_top_sim, 6) mc_top_sim, (mc_top_sim >= 0.999)::int mc_is_exact_match
from frame left join prob using (query_id, microcat) left join per using (query_id) left join top using (query_id)"""


QUERIES = {
    "location_stats": (location_stats, f"with {ITEMS_SQL}, {_STATS} select loc, round(lat, 6) lat, round(lon, 6) lon, n_items from stats"),
    "location_centers": (location_centers, f"with {_PAIRS}, {_centers()} select search_loc, round(lat, 6) lat, round(lon, 6) lon, n_pairs, n_items, round(spread_km, 6) spread_km from centers"),
    "query_centers": (query_centers, f"""with {_PAIRS}, {_STATS}, {_centers('search_loc % 3 <> 0')} select p.search_loc, round(coalesce(s.lat, c.lat), 6) lat, round(coalesce(s.lon, c.lon), 6) lon, case when s.loc is not null then 0 when c.search_loc is not null then 1 else 2 end center_source
from (select distinct search_loc from pairs) p left join (select * from stats where loc % 2 = 0) s on s.loc = p.search_loc left join centers c on c.search_loc = p.search_loc"""),
    "history_pairs": (history_pair_counts, f"with {_PAIRS} select fold, item_loc, count(*) n, count(distinct query_text) texts from pairs group by 1, 2"),
    "crossfit_history": (crossfit_history, f"with {_PAIRS}, {_VIEWS}, a as (select view_id, count(*) queries from vq group by 1), b as (select view_id, count(*) pairs, count(distinct query_text) texts from vp group by 1) select view_id, coalesce(queries, 0) queries, coalesce(pairs, 0) pairs, coalesce(texts, 0) texts from a full join b using (view_id)"),
    "location_share": (location_share, f"with {ITEMS_SQL}, {_SHARE} select loc, round(share, 6) share from share0"),
    "transitions": (transitions, f"with {_PAIRS}, {_SHARE}, share as (select * from share0 where loc % 3 <> 1), {_TRANS.format('pairs')} select search_loc, item_loc, n, support, targets, round(outside_share, 6) outside_share from counts join totals using (search_loc)"),
    "transition_features": (transition_features, f"""with {_PAIRS}, {_SHARE}, share as (select * from share0 where loc % 3 <> 1), seen as (select * from pairs where search_loc % 5 <> 0), {_TRANS.format('seen')}, {_FRAME},
j as (select f.*, coalesce(n, 0) n, coalesce(support, 0) support, coalesce(targets, 0) targets, outside_share, coalesce(share, 0) p from frame f left join counts using (search_loc, item_loc) left join totals using (search_loc) left join share s on s.loc = item_loc)
select item_loc, search_loc, doc_id, round((n + 10.0e0 * p) / (support + 10.0e0), 6) trans_prob, n trans_pairs, support trans_support, targets trans_targets, (n = 0)::int trans_unknown, case when p > 0 then round(ln(1 + (n + 10.0e0 * p) / (support + 10.0e0) / p), 6) end trans_lift, round(outside_share, 6) trans_outside_share from j"""),
    "geo_fallback": (geo_fallback, f"with {_FALL} select search_loc, doc_id, item_loc, round(dist_km, 6) dist_km, round(hist_dist_km, 6) hist_dist_km, center_source, hist_pairs, round(hist_spread_km, 6) hist_spread_km from fall"),
    "geo_damping": (geo_damping, f"with {_FALL}, b as (select *, center_source = 1 and (coalesce(hist_spread_km > 75, false) or hist_pairs < 5) bad from fall) select search_loc, doc_id, bad::int geo_unreliable, round(case when bad then -1.0e0 else case when dist_km is not null then ln(1 + least(greatest(dist_km, 0), 1000)) end end, 6) log_dist_clean from b"),
    "crossfit_transitions": (crossfit_transitions, f"""with {_PAIRS}, {_VIEWS}, {_SHARE}, c as (select view_id, search_loc, item_loc, count(*) n from vp group by 1, 2, 3)
select view_id, search_loc, coalesce(sum(n) filter (where s.loc is not null), 0)::bigint support, count(s.loc) targets, round(sum(case when s.loc is null then n else 0 end) / sum(n)::double, 6) outside_share, max(n) most from c left join share0 s on s.loc = item_loc group by 1, 2"""),
    "text_microcats": (text_microcats, f"with {_PAIRS}, c as (select query_text, microcat, count(*) n from pairs where microcat is not null group by 1, 2) select query_text, microcat, round(n / sum(n) over (partition by query_text), 6) share from c"),
    "neighbor_microcats": (neighbor_microcats, _mc_sql("exp((score - mc_top_sim) / 0.05e0)")),
    "exact_microcats": (exact_microcats, _mc_sql("case when mc_top_sim >= 0.999 then (score >= 0.998)::int::double else exp((score - mc_top_sim) / 0.05e0) end")),
    "neighbor_centroid_cos": (neighbor_centroid_cos, f"""with {_NB.format('true')}, chosen as (select distinct 't' || vec_id query_text, unnest([vec_id, vec_id + 1]) item_id from v),
cells as (select query_text, u.pos, avg(embedding[u.pos]::double) m from chosen join v on vec_id = item_id, (select unnest(range(1, 65)) pos) u group by 1, 2),
w0 as (select *, exp((score - max(score) over (partition by query_id)) / 0.05e0) r from nb), w as (select *, r / sum(r) over (partition by query_id) w from w0),
sums as (select query_id, pos, sum(w * m) s from w join cells using (query_text) group by 1, 2), unit as (select query_id, pos, s / sqrt(sum(s * s) over (partition by query_id)) s from sums),
hits as (select query_id, p.vec_id, row_number() over (partition by query_id order by round(list_inner_product(q.embedding::double[], p.embedding::double[]), 9) desc, p.vec_id) rrf_rank from q, v p qualify rrf_rank <= 20),
cos as (select query_id, vec_id doc_id, rrf_rank, sum(s * embedding[pos]::double) c from hits join v using (vec_id) join unit using (query_id) group by 1, 2, 3)
select query_id, doc_id, rrf_rank, round(c, 6) nb_cos, row_number() over (partition by query_id order by round(c, 9) desc, rrf_rank) nb_cos_rank from cos"""),
    "views_union": (views_union, f"with {_PAIRS}, {_VIEWS} select distinct query_text, item_id, item_loc from vp"),
    "region_core": (region_core, f"with {_PAIRS}, c as (select search_loc, item_loc, count(*) n from pairs group by 1, 2), m as (select *, coalesce(sum(n) over (partition by search_loc order by n desc, item_loc rows between unbounded preceding and 1 preceding), 0) / sum(n) over (partition by search_loc) b from c) select search_loc, item_loc, n, round(b, 6) mass_before from m where b < 0.9"),
    "region_hits": (region_hits, """with c as (select vec_id % 5 search_loc, label item_loc, count(*) n from embeddings group by 1, 2), core as (select *, coalesce(sum(n) over (partition by search_loc order by n desc, item_loc rows between unbounded preceding and 1 preceding), 0) / sum(n) over (partition by search_loc) b from c qualify b < 0.9),
sims as (select q.vec_id query_id, p.vec_id doc_id, list_inner_product(q.embedding::double[], p.embedding::double[]) score from embeddings q join core on search_loc = (q.vec_id // 100) % 5 join embeddings p on p.label = item_loc where q.vec_id % 100 = 0)
select query_id, doc_id, round(score, 6) score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sims qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 5"""),
}
