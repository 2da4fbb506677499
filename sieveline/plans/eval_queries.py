"""Queries on the feature table, ranking, metrics, diagnostics and answers, each with its SQL."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import diagnostics, evaluation, features, finetune, fusion, geo, lexical, ranker, split, submission
from sieveline.plans.history_queries import _KM, _STATS
from sieveline.plans.retrieval_queries import TOKENS, _bm25_sql
from sieveline.plans.text_queries import CONTEXTS_SQL, contexts, hash_sql, sample_sql
from sieveline.sources import io
from sieveline.sources.adapter import ITEMS_SQL, items, read

N_QUERIES, DEPTH, TOP = split.EVAL_QUERIES, 80, 20
LISTS = {"bm25_global": 60, "bm25_local": 40}


def _queries(spark, d) -> DataFrame:
    """The evaluation sample, a context of each of its texts."""
    return split.sample_queries(contexts(spark, d), N_QUERIES).persist()


def _lists(spark, d, queries: DataFrame, own: DataFrame) -> dict:
    docs = own.select(F.col("item_id").alias("doc_id"), F.concat_ws(" ", "title", "params").alias("text"), "loc")
    idx = lexical.index(docs)
    asked = queries.select("query_id", F.col("query_text").alias("text"), "search_loc")
    return {"bm25_global": (lexical.search(idx, asked, DEPTH), LISTS["bm25_global"]), "bm25_local": (lexical.search_local(idx, asked, DEPTH, "search_loc", docs), LISTS["bm25_local"])}


def frame(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of the candidates of a sample of queries, the queries, and the items."""
    queries, own = _queries(spark, d), items(spark, d).persist()
    pool = fusion.candidate_pool(_lists(spark, d, queries, own))
    return features.build_features(pool, queries, own, geo.location_stats(own)), queries, own


def _scored(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    built, queries, own = frame(spark, d)
    return ranker.model_ranks(built.withColumn("score", ranker.linear_score())), queries, own


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def base_features(spark, d):
    built = features.check_contract(frame(spark, d)[0], features.BASE_FEATURES)
    return _rounded(built, "title_overlap", "params_overlap", "dist_km", "rrf", "price").withColumn("query_words", F.col("query_words").cast("long"))


def labels_attached(spark, d):
    built, queries, _ = frame(spark, d)
    labelled = features.attach_labels(built, queries)
    own = features.with_positive(labelled)
    return own.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


def select_top50(spark, d):
    scored, queries, _ = _scored(spark, d)
    best = ranker.select_top(scored, queries)
    return best.select("query_id", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), " ").alias("ids"))


def answer(spark, d):
    scored, queries, _ = _scored(spark, d)
    return submission.answer_frame(ranker.select_top(scored, queries), TOP)


def recall_at_k(spark, d):
    scored, queries, _ = _scored(spark, d)
    joined = queries.join(ranker.select_top(scored, queries, 1000), "query_id")
    return joined.select("query_id", *(F.round(evaluation.recall_at_k(F.col("doc_ids"), F.col("item_ids"), k), 6).alias(f"r{k}") for k in (10, 20, 50)))


def recall_report(spark, d):
    scored, queries, own = _scored(spark, d)
    got = evaluation.recall_report(ranker.select_top(scored, queries, 1000), queries, own.where("item_id % 3 = 0").select("item_id"), (50, 100))
    return _rounded(got, "value")


def _positives(spark, d) -> DataFrame:
    scored, queries, own = _scored(spark, d)
    return diagnostics.positive_outcomes(queries, scored, features.item_table(own), geo.location_stats(own), own.where("item_id % 3 = 0").select("item_id"), TOP)


def positive_outcomes(spark, d):
    cols = ["query_id", "doc_id", "n_pos", "words", "filters_set", "has_center", "item_loc", "item_seen", "same_location", "in_pool", "in_top", "model_rank", "n_lists", "filter_overlap"]
    return _rounded(_positives(spark, d).select(*cols), "filter_overlap")


def query_outcomes(spark, d):
    return _rounded(diagnostics.query_outcomes(_positives(spark, d)), "recall", "pool_recall")


def loss_breakdown(spark, d):
    return _rounded(diagnostics.loss_breakdown(_positives(spark, d)), "recall", "pool_recall", "retrieval_loss", "selection_loss")


def error_map(spark, d):
    cols = ["recall", "retrieval_loss", "selection_loss", "overlap_kept", "overlap_lost", "dist_kept", "dist_lost"]
    return _rounded(diagnostics.error_map(_positives(spark, d)), *cols)


def error_examples(spark, d):
    from sieveline.functions.text import stable_hash

    scored, queries, _ = _scored(spark, d)
    got = diagnostics.error_examples(_positives(spark, d), ranker.select_top(scored, queries), stable_hash(F.col("query_id"), "examples"), 10)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return got.select("query_id", join("lost_ids").alias("lost"), join("selected_ids").alias("selected"))


def _runs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Outcomes of two scorers by query, written as stored runs are."""
    built, queries, own = frame(spark, d)
    out = []
    for weights in (ranker.LINEAR, {"rrf": 1.0}):
        scored = ranker.model_ranks(built.withColumn("score", ranker.linear_score(weights)))
        positives = diagnostics.positive_outcomes(queries, scored, features.item_table(own), geo.location_stats(own), own.select("item_id"), TOP)
        path = io.scratch(spark, "outcomes")
        diagnostics.query_outcomes(positives).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out[0], out[1]


def compare_runs(spark, d):
    a, b = _runs(spark, d)
    return _rounded(evaluation.aligned(a, b).withColumn("diff", F.col("recall_a") - F.col("recall_b")), "recall_a", "recall_b", "pool_a", "pool_b", "diff")


def average_runs(spark, d):
    return _rounded(evaluation.average_runs(list(_runs(spark, d))), "recall")


def paired_bootstrap(spark, d):
    """Both runs compared by slices."""
    a, b = _runs(spark, d)
    got = evaluation.compare_runs(a, b, masks={"filters_set": F.col("filters_set"), "no_centre": ~F.col("has_center")})
    return _rounded(got, "diff", "low", "high")


def bootstrap_by_hash(spark, d):
    """The interval of one difference: of the recalls in the whole pool and in the first ranks."""
    a, _ = _runs(spark, d)
    diffs = a.select("query_id", (F.col("pool_recall") - F.col("recall")).alias("diff"))
    return _rounded(evaluation.bootstrap(diffs), "diff", "low", "high")


def validate_answer(spark, d):
    """A faulty answer to the benchmark's ids, with each kind of violation."""
    ids = F.format_string("%016d", "item_id")
    queries = read(spark, d, "benchmark").select(ids.alias("query_id"))
    known = queries.select(F.col("query_id").alias("item_id"))
    k = F.col("item_id") % 8
    text = F.when(k == 0, ids).when(k == 1, "").when(k == 2, F.concat_ws(" ", ids, ids)).when(k == 3, "nothing").when(k == 4, F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda x: F.format_string("%016d", x)))).when(k == 5, F.format_string("%016d", F.lit(10**9))).otherwise(ids)
    own = read(spark, d, "benchmark").where(k != 6).select(F.when(k == 7, F.concat(F.lit("x"), ids)).otherwise(ids).alias("query_id"), text.alias("answer"))
    own = own.unionByName(own.where("query_id like '%8'").select("query_id", F.lit("nothing").alias("answer")))
    return submission.validate_answer(own, queries, known, 5)


def hard_negatives(spark, d):
    queries, own = _queries(spark, d), items(spark, d)
    hits = _lists(spark, d, queries, own)["bm25_global"][0]
    return finetune.pick_triples(hits, queries, 10, 60)


def few_per_text(spark, d):
    return finetune.few_per_text(contexts(spark, d), 4).select("query_id", "query_text")


def ranker_gbt(spark, d):
    """Boosted trees learnt from the queries outside the validation bucket, applied to those in it."""
    built, queries, _ = frame(spark, d)
    names = ["rrf", "title_overlap", "params_overlap", "loc_match", "dist_km", "price"]
    labelled = features.attach_labels(built, queries).select("query_id", "query_text", "doc_id", "rrf_rank", "label", *names)
    path = io.scratch(spark, "labelled")
    labelled.write.parquet(path)
    labelled, held = spark.read.parquet(path), split.valid_bucket(F.col("query_text"))
    model = ranker.train_gbt(features.with_positive(labelled.where(~held)), names, trees=20, depth=4)
    return ranker.model_ranks(ranker.predict_gbt(model, labelled.where(held), names)).select("query_id", "doc_id", "score", "model_rank", "label")


def unique_batches(spark, d):
    """The training triples dealt into batches that hold no text or item twice."""
    queries, own = _queries(spark, d), items(spark, d)
    triples = finetune.pick_triples(_lists(spark, d, queries, own)["bm25_global"][0], queries, 10, 60).join(queries.select("query_id", "query_text"), "query_id")
    rows = [(r["query_text"], r["pos"], r["neg"]) for r in triples.orderBy("query_id").collect()]  # a triple for each query of the sample
    found = [(k, *row) for k, batch in enumerate(finetune.unique_batches(rows, 16)) for row in batch]
    return spark.createDataFrame(found, "batch long, query_text string, pos long, neg long")


_LONG = "docs as (select item_id doc_id, concat_ws(' ', title, params) as text, loc from items), queries0 as (select *, query_text as text from ctx)"
_CUT = "row_number() over (partition by query_id order by round(score, 9) desc, doc_id)"
_FRAME = f"""with {CONTEXTS_SQL}, {ITEMS_SQL}, {_STATS}, ctx as {sample_sql(N_QUERIES)}, {_LONG}, {_bm25_sql('docs', 'queries0')},
a as (select query_id, doc_id, {_CUT} as rank from scored qualify {_CUT} <= {LISTS['bm25_global']}),
l0 as (select s.* from scored s join docs using (doc_id) join queries0 using (query_id) where loc = search_loc), b as (select query_id, doc_id, {_CUT} as rank from l0 qualify {_CUT} <= {LISTS['bm25_local']}),
hits as (select query_id, doc_id, {_CUT} as rank from scored qualify {_CUT} <= {DEPTH}),
p0 as (select query_id, doc_id, round(coalesce(1.0e0 / (60 + a.rank), 0) + coalesce(1.0e0 / (60 + b.rank), 0), 12) rrf, (a.rank is not null)::int + (b.rank is not null)::int n_lists from a full join b using (query_id, doc_id)),
pool as (select *, row_number() over (partition by query_id order by rrf desc, doc_id) rrf_rank from p0),
it as (select item_id doc_id, loc item_loc, i.*, list_distinct({TOKENS.format('title')}) tset, list_distinct({TOKENS.format('substr(params, 1, 500)')}) pset from items i),
f as (select pool.*, c.query_text, c.search_loc, c.filters, it.item_loc, it.price, len(list_intersect(q, tset)) / len(q)::double title_overlap, len(list_intersect(q, pset)) / len(q)::double params_overlap, (item_loc = search_loc)::int loc_match, (it.category = c.category)::int cat_match,
  {_KM.format('s.lat', 's.lon', 'it.lat', 'it.lon')} dist_km, 0 query_cat_zero, (filters = '')::int filters_empty, len(string_split(query_text, ' ')) query_words, coalesce(n_items, 0) location_items, length(title) title_chars, length(params) params_chars, pset, it.item_id
  from pool join (select *, list_distinct({TOKENS.format('query_text')}) q from ctx) c using (query_id) join it using (doc_id) left join stats s on s.loc = search_loc)"""


def _ranked(weights: dict[str, float], name: str = "ranked") -> str:
    score = " + ".join(f"coalesce({f}::double, 0) * {w}e0" for f, w in weights.items())
    return f"{name} as (select *, row_number() over (partition by query_id order by round({score}, 9) desc, rrf_rank) model_rank from f)"


_SCORED = f"{_FRAME}, {_ranked(ranker.LINEAR)}"


def _pos(source: str, name: str, seen: str = "doc_id % 3 = 0") -> str:
    return f"""{name} as (select c.query_id, c.doc_id, count(*) over (partition by c.query_id) n_pos, case when len(string_split(query_text, ' ')) >= 4 then '4+' else len(string_split(query_text, ' '))::varchar end words, filters <> '' filters_set, st.loc is not null has_center, i.loc item_loc, c.{seen} item_seen,
  i.loc = search_loc same_location, r.model_rank is not null in_pool, coalesce(r.model_rank <= {TOP}, false) in_top, r.model_rank, r.n_lists, r.dist_km,
  case when filters <> '' then len(list_intersect(list_distinct(string_split(lower(filters), ' ')), list_distinct({TOKENS.format('substr(i.params, 1, 500)')}))) / len(list_distinct(string_split(filters, ' ')))::double end filter_overlap
  from (select *, unnest(item_ids) doc_id from ctx) c left join stats st on st.loc = search_loc left join items i on i.item_id = c.doc_id left join (select query_id, doc_id, model_rank, n_lists, dist_km from {source}) r using (query_id, doc_id))"""


_POS = f"{_SCORED}, {_pos('ranked', 'pos')}"
_OUT = "select query_id, words, filters_set, has_center, count(*) n_pos, avg(in_top::int) recall, avg(in_pool::int) pool_recall, bool_or(not coalesce(same_location, false)) any_other_location from {} group by 1, 2, 3, 4"
_LOSS = "coalesce(sum(1.0e0 / (n_pos * nq)) filter (where {}), 0)"
_BUCKET = "case when model_rank is null then 'not_in_pool' when model_rank <= 50 then '1-50' when model_rank <= 100 then '51-100' when model_rank <= 300 then '101-300' else '>300' end"
_BY = {"same_location": "same_location::varchar", "has_center": "has_center::varchar", "words": "words", "filters_set": "filters_set::varchar", "item_seen": "item_seen::varchar", "n_lists": "n_lists::varchar", "model_rank": _BUCKET, "multi_positive": "(n_pos > 1)::varchar"}
_RECALL = "len(list_intersect(coalesce(ids[:{0}], []), item_ids)) / len(item_ids)::double"
_PRED = "pred as (select query_id, item_ids, query_text, filters, category, ids from ctx left join (select query_id, list(doc_id order by model_rank) ids from ranked group by 1) using (query_id))"
_TWO = f"{_FRAME}, {_ranked(ranker.LINEAR)}, {_ranked({'rrf': 1.0}, 'plain')}, {_pos('ranked', 'p1')}, {_pos('plain', 'p2')}, o1 as ({_OUT.format('p1')}), o2 as ({_OUT.format('p2')})"
_WEIGHT = " + ".join(f"(u >= {c!r})::int" for c in itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(evaluation.MOST_COPIES)))


def _boot(source: str, by: str, group: str) -> str:
    """CTEs whole (n, diff) and lim (low, high) of the differences d in ``source``, by its column ``by``."""
    u = f"({hash_sql("(query_id || '/' || r)", 'bootstrap')} % 1000003 + 0.5e0) / 1000003"
    tail = f" group by {group}" if group else ""
    return f"""draws as (select query_id, r, {_WEIGHT} w from (select query_id, r, {u} u from (select distinct query_id from {source}), range({evaluation.RESAMPLES}) t(r))),
sums as (select {by}r, sum(w * round(d * 1000000000)::bigint)::double / nullif(sum(w), 0) / 1000000000 m from draws join {source} using (query_id) where w > 0 group by {by}r),
lim as (select {by}quantile_cont(m, 0.025) low, quantile_cont(m, 0.975) high from sums{tail}), whole as (select {by}count(*) n, avg(d) diff from {source}{tail})"""


_ROWS = {
    **{f"recall@{k}": ("count(*)", f"avg({_RECALL.format(k)})") for k in (50, 100)}, "mean_pool_size": ("count(*)", "avg(coalesce(len(ids), 0)::double)"), "empty_pools": ("count(*)", "sum((coalesce(len(ids), 0) = 0)::int::double)"),
    **{n: (f"count(*) filter (where {c})", f"avg({_RECALL.format(50)}) filter (where {c})") for n, c in {"filters_empty": "filters = ''", "filters_set": "filters <> ''", "category_0": "category = '0'", "words_1": "nw = 1", "words_2": "nw = 2", "words_3": "nw = 3", "words_4plus": "nw >= 4"}.items()},
    "new_items": ("count(*) filter (where len(fresh) > 0)", "avg(len(list_intersect(coalesce(ids[:50], []), fresh)) / len(fresh)::double) filter (where len(fresh) > 0)"),
}

_IDS = "lpad(item_id::varchar, 16, '0')"

QUERIES = {
    "base_features": (base_features, f"{_FRAME} select query_id, doc_id, round(title_overlap, 6) title_overlap, round(params_overlap, 6) params_overlap, loc_match, cat_match, round(dist_km, 6) dist_km, query_cat_zero, filters_empty, query_words, location_items, round(price, 6) price, title_chars, params_chars, round(rrf, 6) rrf, rrf_rank, n_lists from f"),
    "labels_attached": (labels_attached, f"{_FRAME}, lab as (select f.query_id, list_contains(item_ids, doc_id)::int y from f join ctx using (query_id)) select query_id, count(*) n, sum(y)::bigint positives from lab group by 1 having sum(y) > 0"),
    "select_top50": (select_top50, f"{_SCORED}, best as (select query_id, string_agg(doc_id::varchar, ' ' order by model_rank) ids from ranked where model_rank <= 50 group by 1) select query_id, coalesce(ids, '') ids from ctx left join best using (query_id)"),
    "answer": (answer, f"{_SCORED}, best as (select query_id, string_agg(doc_id::varchar, ' ' order by model_rank) answer from ranked where model_rank <= {TOP} group by 1) select query_id, coalesce(answer, '') answer from ctx left join best using (query_id)"),
    "recall_at_k": (recall_at_k, f"{_SCORED}, {_PRED} select query_id, {', '.join(f'round({_RECALL.format(k)}, 6) r{k}' for k in (10, 20, 50))} from pred"),
    "recall_report": (recall_report, f"{_SCORED}, {_PRED}, x as (select *, len(string_split(query_text, ' ')) nw, list_filter(item_ids, lambda i: i % 3 <> 0) fresh from pred) " + " union all ".join(f"select '{m}' metric, {n} n, round({v}, 6) as value from x" for m, (n, v) in _ROWS.items())),
    "positive_outcomes": (positive_outcomes, f"{_POS} select query_id, doc_id, n_pos, words, filters_set, has_center, item_loc, item_seen, same_location, in_pool, in_top, model_rank, n_lists, round(filter_overlap, 6) filter_overlap from pos"),
    "query_outcomes": (query_outcomes, f"{_POS}, o as ({_OUT.format('pos')}) select * replace (round(recall, 6) as recall, round(pool_recall, 6) as pool_recall) from o"),
    "loss_breakdown": (loss_breakdown, f"{_POS}, x as (select *, (select count(distinct query_id) from pos) nq from pos) " + " union all ".join(f"""select '{n}' as by, {e} as "group", count(*) positives, count(distinct query_id) queries, round(avg(in_top::int), 6) recall, round(avg(in_pool::int), 6) pool_recall, round({_LOSS.format('not in_pool')}, 6) retrieval_loss, round({_LOSS.format('in_pool and not in_top')}, 6) selection_loss from x group by 2""" for n, e in _BY.items())),
    "error_map": (error_map, f"""{_POS}, x as (select *, (select count(distinct query_id) from pos) nq from pos) select count(distinct query_id) queries, count(*) positives, round({_LOSS.format('in_top')}, 6) recall, round({_LOSS.format('not in_pool')}, 6) retrieval_loss, round({_LOSS.format('in_pool and not in_top')}, 6) selection_loss,
count(distinct query_id) filter (where not in_pool) queries_with_retrieval_miss, count(distinct query_id) filter (where in_pool and not in_top) queries_with_selection_miss, round(avg(filter_overlap) filter (where in_top), 6) overlap_kept, round(avg(filter_overlap) filter (where not in_top), 6) overlap_lost,
round(median(dist_km) filter (where in_top), 6) dist_kept, round(median(dist_km) filter (where in_pool and not in_top), 6) dist_lost from x"""),
    "error_examples": (error_examples, f"""{_POS}, lost as (select query_id, string_agg(doc_id::varchar, ' ' order by doc_id) lost from pos where not in_top group by 1), sel as (select query_id, string_agg(doc_id::varchar, ' ' order by model_rank) selected from ranked where model_rank <= 5 group by 1)
select query_id, lost, coalesce(selected, '') selected from lost left join sel using (query_id) order by {hash_sql('query_id', 'examples')}, query_id limit 10"""),
    "compare_runs": (compare_runs, f"{_TWO} select query_id, round(o1.recall, 6) recall_a, round(o1.pool_recall, 6) pool_a, round(o2.recall, 6) recall_b, round(o2.pool_recall, 6) pool_b, round(o1.recall - o2.recall, 6) diff from o1 join o2 using (query_id)"),
    "average_runs": (average_runs, f"{_TWO} select query_id, round((o1.recall + o2.recall) / 2, 6) recall from o1 join o2 using (query_id)"),
    "paired_bootstrap": (paired_bootstrap, f"""{_TWO}, x as (select o1.query_id, o1.recall - o2.recall d, o1.pool_recall - o2.pool_recall pd, o1.filters_set, o1.has_center from o1 join o2 using (query_id)),
g as (select query_id, 'overall' slice, d from x union all select query_id, 'filters_set', d from x where filters_set union all select query_id, 'no_centre', d from x where not has_center union all select query_id, 'pool', pd from x), {_boot('g', 'slice, ', 'slice')}
select slice, n, round(diff, 6) diff, round(low, 6) low, round(high, 6) high, case when low > 0 then 'better' when high < 0 then 'worse' else 'undetermined' end verdict from whole join lim using (slice)"""),
    "bootstrap_by_hash": (bootstrap_by_hash, f"""{_TWO}, g as (select query_id, pool_recall - recall d from o1), {_boot('g', '', '')}
select n, round(diff, 6) diff, round(low, 6) low, round(high, 6) high from whole, lim"""),
    "unique_batches": (unique_batches, None),
    "validate_answer": (validate_answer, f"""with known as (select {_IDS} id from benchmark), own0 as (select case when item_id % 8 = 7 then 'x' || {_IDS} else {_IDS} end query_id, case item_id % 8 when 0 then {_IDS} when 1 then '' when 2 then {_IDS} || ' ' || {_IDS} when 3 then 'nothing'
  when 4 then array_to_string([lpad(x::varchar, 16, '0') for x in range(6)], ' ') when 5 then lpad('1000000000', 16, '0') else {_IDS} end answer from benchmark where item_id % 8 <> 6),
own as (select * from own0 union all select query_id, 'nothing' from own0 where query_id like '%8'), x as (select *, string_split(answer, ' ') ids from own), g as (select query_id, count(*) c from own group by 1)
select query_id, 'duplicate query' violation from g where c > 1 union all select id, 'missing query' from known where id not in (select query_id from g) union all select query_id, 'extra query' from g where query_id not in (select id from known)
union all select query_id, 'query id length' from g where length(query_id) <> 16
union all select query_id, v from (select query_id, case when answer = '' then 'empty' when len(ids) > 5 then 'too many items' when len(list_distinct(ids)) < len(ids) then 'duplicate items' when not list_has_all((select list(id) from known), ids) then 'malformed or outside' end v from x) where v is not null"""),
    "hard_negatives": (hard_negatives, f"""{_FRAME}, chosen as (select query_id, query_text, unnest(item_ids) pos from ctx), band as (select query_id, doc_id neg, query_text from hits join ctx using (query_id) where rank > 10 and rank <= 60), ok as (select * from band b where not exists (select 1 from chosen c where c.query_text = b.query_text and c.pos = b.neg)),
p as (select query_id, pos from chosen qualify row_number() over (partition by query_id order by {hash_sql("(query_id || chr(31) || pos)")}, pos) = 1), ng as (select query_id, neg from ok qualify row_number() over (partition by query_id order by {hash_sql("(query_id || chr(31) || neg)")}, neg) = 1)
select query_id, pos, neg from p join ng using (query_id)"""),
    "few_per_text": (few_per_text, f"with {CONTEXTS_SQL} select query_id, query_text from contexts qualify row_number() over (partition by query_text order by {hash_sql('query_id')}, query_id) <= 4"),
    "ranker_gbt": (ranker_gbt, None),
}
