"""Queries on texts, splits and contexts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.operators import lexical, split
from sieveline.sources.adapter import ITEMS_SQL, LOG_SQL, interactions, items, read

CONTEXT_KEYS = ["query_text", "search_loc", "filters", "category"]


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of the log; persisted, as most queries on them use them more than once."""
    return split.build_contexts(interactions(spark, sf_dir), CONTEXT_KEYS).persist()


def hash_sql(value: str, seed: str = split.SEED) -> str:
    return f"('0x' || substr(sha256('{seed}' || chr(31) || {value}), 1, 16))::ubigint"


def part_sql(value: str) -> str:
    return f"case when {hash_sql(value)} % 10000 < 8000 then 'train' when {hash_sql(value)} % 10000 < 9000 then 'dev' else 'test' end"


NORMAL_SQL = r"trim(regexp_replace(replace(lower(coalesce({}, '')), 'ё', 'е'), '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'))"
CONTEXTS_SQL = f"""{LOG_SQL},
contexts as (select query_text, search_loc, filters, category, list_sort(list(distinct item_id)) item_ids,
  substr(sha256(query_text || chr(31) || search_loc || chr(31) || filters || chr(31) || category), 1, 16) query_id from log group by 1, 2, 3, 4)"""
FOLD_SQL = f"cast({hash_sql('''('history' || chr(31) || query_text)''')} % 5 as int)"


def sample_sql(n: int, source: str = "contexts") -> str:
    text_hash = hash_sql("('text' || chr(31) || query_text)")
    return f"""(select * from {source} where query_text in (select query_text from (select distinct query_text from {source}) order by {text_hash}, query_text limit {n})
  qualify row_number() over (partition by query_text order by {hash_sql('query_id')}, query_id) = 1)"""


def normalize_texts(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", tx.normalize_text(F.col("text")).alias("normal"), tx.clean(F.col("source")).alias("cleaned"), tx.space_words(F.col("source")).cast("long").alias("n_words"))


def split_assign(spark, d):
    return split.assign_parts(interactions(spark, d))


def split_shares(spark, d):
    parts = split.assign_parts(read(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("query_text")))
    return parts.groupBy("part").agg(F.count("*").alias("n"))


def context_table(spark, d):
    return contexts(spark, d).select("query_id", "query_text", "search_loc", "filters", "category", F.array_join(F.transform("item_ids", lambda x: x.cast("string")), " ").alias("items"))


def corpus(spark, d):
    log = read(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return split.build_corpus(log)


def eval_sample(spark, d):
    return split.sample_queries(contexts(spark, d), 40).select("query_id", "query_text", "search_loc")


def repeated_texts(spark, d):
    own = contexts(spark, d)
    excluded = split.assign_parts(own).where("part = 'test'").select("query_text")
    return split.repeated_text_queries(own, excluded, 20).select("query_id", "query_text")


def text_folds(spark, d):
    own = interactions(spark, d).select("query_text").distinct()
    return own.select("query_text", split.text_fold(F.col("query_text")).alias("fold"), split.valid_bucket(F.col("query_text")).alias("in_valid"))


def valid_roles(spark, d):
    own = contexts(spark, d)
    marked = split.roles(own, split.fixed_valid_texts(own, 30, 300), 300)
    return marked.groupBy("valid", "excluded").agg(F.count("*").alias("n"))


def item_documents(spark, d):
    t, p = F.col("title"), F.col("params")
    q = lexical.query_text(tx.normalize_text(t), F.col("category"), True)
    passage = F.concat(F.lit("passage: "), F.concat_ws("\n", tx.clean(t), tx.clean(F.substring(p, 1, 10))))
    return items(spark, d).select("item_id", lexical.item_document(t, p, F.col("microcat"), 3).alias("document"), q.alias("query"), passage.alias("passage"))


def filter_features(spark, d):
    """Filters of four keys made from the items' own columns, matched against their parameters."""
    own = items(spark, d)
    text = F.concat_ws(" ", F.lit("Вид услуги"), "microcat", F.lit("Тип услуги"), F.when(F.col("item_id") % 3 == 0, F.col("category")).otherwise("none"), F.when(F.col("item_id") % 2 == 0, F.lit("Онлайн-запись да")))
    params = F.concat_ws(" ", F.lit("Вид услуги"), "microcat", F.lit("Тип услуги"), "category", F.when(F.col("item_id") % 5 == 0, F.lit("Онлайн-запись")))
    rows = own.select("item_id", tx.parse_filters(text).alias("f"), params.alias("params"))
    match = tx.filter_match(F.col("f"), F.col("params"))
    return rows.select("item_id", F.try_element_at("f", F.lit("Вид услуги")).alias("kind"), *(c.alias(n) for n, c in match.items()), *tx.marker_columns(F.col("params")), tx.has_mixed_script(F.col("params")).alias("mixed"))


def mask_excerpts(spark, d):
    talks = read(spark, d, "conversations").select("conv_id", "turn", tx.mask_excerpt(F.col("text")).alias("excerpt"))
    return talks


def mixed_script_share(spark, d):
    docs = read(spark, d, "documents")
    return docs.groupBy("lang").agg(F.round(F.avg(tx.has_mixed_script(F.col("text")).cast("double")), 6).alias("share"), F.round(F.avg(tx.normalize_text(F.col("text")).rlike("[а-я]").cast("double")), 6).alias("cyrillic"))


_F = "concat_ws(' ', 'Вид услуги', microcat, 'Тип услуги', case when item_id % 3 = 0 then category else 'none' end, case when item_id % 2 = 0 then 'Онлайн-запись да' end)"
_P = "concat_ws(' ', 'Вид услуги', microcat, 'Тип услуги', category, case when item_id % 5 = 0 then 'Онлайн-запись' end)"
_D = "cast({} as double)"

QUERIES = {
    "normalize_texts": (normalize_texts, rf"select doc_id, {NORMAL_SQL.format('text')} normal, nullif(trim(regexp_replace(source, '[\s\p{{Z}}]+', ' ', 'g')), '') cleaned, len(string_split(source, ' ')) n_words from documents"),
    "split_assign": (split_assign, f"with {LOG_SQL} select query_text, {part_sql('query_text')} part from (select distinct query_text from log)"),
    "split_shares": (split_shares, f"select {part_sql('query_text')} part, count(*) n from (select distinct concat_ws(' ', p_name, p_brand) query_text from part) group by 1"),
    "contexts": (context_table, f"with {CONTEXTS_SQL} select query_id, query_text, search_loc, filters, category, array_to_string(item_ids, ' ') items from contexts"),
    "corpus": (corpus, "select l_partkey item_id, min((l_returnflag, l_linestatus))[1] flag, min((l_returnflag, l_linestatus))[2] status from lineitem group by 1"),
    "eval_sample": (eval_sample, f"with {CONTEXTS_SQL} select query_id, query_text, search_loc from {sample_sql(40)}"),
    "repeated_texts": (repeated_texts, f"with {CONTEXTS_SQL}, kept as (select * from contexts where {part_sql('query_text')} <> 'test' and query_text in (select query_text from contexts group by 1 having count(*) >= 2)) select query_id, query_text from {sample_sql(20, 'kept')}"),
    "text_folds": (text_folds, f"with {LOG_SQL} select query_text, {FOLD_SQL} fold, {hash_sql('''('valid' || chr(31) || query_text)''')} % 1000 < 100 in_valid from (select distinct query_text from log)"),
    "valid_roles": (valid_roles, f"""with {CONTEXTS_SQL}, marked as (select query_text, {hash_sql("('valid' || chr(31) || query_text)")} % 1000 < 300 bucket from contexts),
fixed as (select query_text from {sample_sql(30)} where {hash_sql("('valid' || chr(31) || query_text)")} % 1000 < 300)
select query_text in (select query_text from fixed) as valid, bucket and query_text not in (select query_text from fixed) excluded, count(*) n from marked group by 1, 2"""),
    "item_documents": (item_documents, rf"""with {ITEMS_SQL} select item_id, concat_ws(' ', {NORMAL_SQL.format('title')}, {NORMAL_SQL.format('title')}, {NORMAL_SQL.format('title')}, {NORMAL_SQL.format('params')}, {NORMAL_SQL.format('microcat')}) document,
concat_ws(' ', {NORMAL_SQL.format('title')}, {NORMAL_SQL.format('category')}) query, 'passage: ' || concat_ws(chr(10), trim(title), trim(substr(params, 1, 10))) passage from items"""),
    "filter_features": (filter_features, f"""with {ITEMS_SQL}, rows as (select *, {_P} p from items),
m as (select item_id, p, microcat kind, {_D.format("contains(p, 'Вид услуги ' || microcat)")} filt_vid, {_D.format("contains(p, 'Тип услуги ' || case when item_id % 3 = 0 then category else 'none' end)")} filt_tip,
  case when item_id % 2 = 0 then {_D.format("contains(p, 'Онлайн-запись')")} end filt_booking from rows)
select item_id, kind, filt_vid, filt_tip, cast(null as double) filt_auto, cast(null as double) filt_subject, filt_booking, 2.0e0 + (filt_booking is not null)::int filt_set,
  (filt_vid + filt_tip + coalesce(filt_booking, 0)) / (2.0e0 + (filt_booking is not null)::int) filt_share, {", ".join(f"{_D.format(f'contains(p, {m!r})')} {n}" for n, m in tx.PARAM_MARKERS.items())},
  regexp_matches(lower(p), '[a-z][а-яё]|[а-яё][a-z]') mixed from m"""),
    "mask_excerpts": (mask_excerpts, rf"""with a as (select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'), '[^ @]+@[^ @]+[.][\p{{L}}\p{{N}}_]+', '[email]', 'g'),
  '(^|[^\p{{L}}\p{{N}}_+])[+]?[0-9][0-9 ()-]{{8,}}[0-9]', '\1[number]', 'g') t from conversations) select conv_id, turn, substr(t, 1, 180) || case when length(t) > 180 then '…' else '' end excerpt from a"""),
    "mixed_script_share": (mixed_script_share, rf"select lang, round(avg(regexp_matches(lower(text), '[a-z][а-яё]|[а-яё][a-z]')::int::double), 6) share, round(avg(regexp_matches({NORMAL_SQL.format('text')}, '[а-я]')::int::double), 6) cyrillic from documents group by 1"),
}
