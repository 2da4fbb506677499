"""Profiling queries over the tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import token_set
from sieveline.operators import encode, profile
from sieveline.plans.retrieval_queries import TOKENS
from sieveline.plans.text_queries import CONTEXT_KEYS, CONTEXTS_SQL, contexts
from sieveline.sources.adapter import ITEMS_SQL, LOG_SQL, interactions, items, read
from sieveline.sources import io

ID_PATTERN = "^[0-9]+$"
TABLES = {"documents": "doc_id", "pages": "page_id", "benchmark": "item_id", "events": "event_id"}


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def distribution(spark, d):
    return _rounded(profile.distribution(read(spark, d, "events"), "event_type", "events"), "percent")


def top_values(spark, d):
    docs = read(spark, d, "documents")
    return _rounded(_union(profile.top_values(docs, c, c, 10) for c in ("source", "lang")), "percent")


def quantiles(spark, d):
    events, docs = read(spark, d, "events"), read(spark, d, "documents")
    got = profile.quantiles(events, "value", "events").unionByName(profile.quantiles(docs, "n_chars", "documents"))
    return _rounded(got, *[c for c in got.columns if c not in ("dataset", "column", "n")])


def integrity(spark, d):
    return _union(profile.integrity(read(spark, d, t).select(k, *(["text"] if t in ("documents", "benchmark") else [])), k, ID_PATTERN, t) for t, k in TABLES.items())


def conflicts(spark, d):
    return profile.conflicts(read(spark, d, "lineitem"), "l_partkey", ["l_returnflag", "l_linestatus", "l_linenumber"])


def missingness(spark, d):
    return _rounded(_union(profile.missingness(read(spark, d, t), t) for t in ("documents", "conversations")), "null_percent", "blank_percent")


def _priced(spark, d) -> DataFrame:
    """Items with the columns that the anomaly checks look at."""
    own = items(spark, d)
    k = F.col("item_id")
    return own.select("item_id", F.when(k % 17 == 0, -1.0).when(k % 19 == 0, 0.0).when(k % 23 == 0, 1.0).otherwise(F.col("price") * 10).alias("item_price"), F.when(k % 11 == 0, 5.5).otherwise(4.0).alias("item_rating"), (k / F.when(k % 13 == 0, 2.0).otherwise(1.0)).alias("item_rating_reviews_count"), F.when(k % 29 == 0, 0.0).otherwise(F.col("lat")).alias("item_latitude"), F.when(k % 29 == 0, 0.0).otherwise(F.col("lon")).alias("item_longitude"), (k % 3 == 0).alias("item_is_phone_hidden"), (k % 5 == 0).alias("item_is_message_forbidden"))


def anomalies(spark, d):
    return _rounded(profile.checks(_priced(spark, d), profile.anomalies(), "items"), "percent")


def price_buckets(spark, d):
    return _rounded(profile.bucket_shares(_priced(spark, d), profile.price_buckets(F.col("item_price")), "items"), "percent")


def negative_prices(spark, d):
    return _rounded(profile.distribution(_priced(spark, d).where("item_price < 0"), "item_price", "items"), "percent")


def query_shift(spark, d):
    log = interactions(spark, d).withColumn("part", F.when(F.col("item_id") % 10 == 0, "late").otherwise("early"))
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    return log.groupBy("part").agg(F.count("*").alias("n"), pct(F.col("filters") == "").alias("empty_filters"), pct(F.col("category").startswith("ECONOMY")).alias("economy"), F.countDistinct("search_loc").alias("places"))


def overlap_seen(spark, d):
    log = interactions(spark, d)
    new, old = log.where("item_id % 10 = 0"), log.where("item_id % 10 <> 0")
    keys = {"text": ["query_text"], "text_place": ["query_text", "search_loc"], "context": CONTEXT_KEYS, "item": ["item_id"]}
    return profile.overlap_counts(new.withColumn("filters", F.nullif("filters", F.lit(""))), old.withColumn("filters", F.nullif("filters", F.lit(""))), keys)


def oracle_ceilings(spark, d):
    return _rounded(profile.ceilings(contexts(spark, d), items(spark, d), 2), "unfiltered", "same_location", "same_category")


def supply(spark, d):
    own, queries = items(spark, d), contexts(spark, d)
    return _union([profile.supply(queries, own, "search_loc", "loc", "location"), profile.supply(queries, own, "category", "category", "category")]).withColumns({c: F.col(c).cast("double") for c in ("median",)})


def popularity(spark, d):
    return profile.popularity(interactions(spark, d))


def popularity_mass(spark, d):
    return _rounded(profile.popularity_mass(interactions(spark, d), 10), "top_percent")


def match_rates(spark, d):
    return _rounded(profile.match_rates(interactions(spark, d), items(spark, d)), "same_place_percent")


def positives_per_context(spark, d):
    sizes = contexts(spark, d).select(F.size("item_ids").alias("positives"))
    got = profile.quantiles(sizes, "positives", "contexts")
    return _rounded(got, *[c for c in got.columns if c not in ("dataset", "column", "n")])


def location_cardinalities(spark, d):
    own, log = items(spark, d), interactions(spark, d)
    parts = {"items": own.select("loc"), "searches": log.select(F.col("search_loc").alias("loc")), "suppliers": read(spark, d, "supplier").select(F.col("s_nationkey").alias("loc"))}
    return _union(df.agg(F.lit(n).alias("dataset"), F.countDistinct("loc").alias("places")) for n, df in parts.items())


def text_lengths(spark, d):
    return _rounded(_union(profile.text_profile(read(spark, d, t), k, c, t) for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))), "mean_chars")


def histogram_log(spark, d):
    return profile.histogram(read(spark, d, "documents"), "n_chars", 0.0, 6.0, 24, log=True)


def histogram(spark, d):
    return profile.histogram(read(spark, d, "part"), "p_size", 0.0, 50.0, 10)


def lexical_coverage(spark, d):
    own = items(spark, d).select("item_id", "title", "params", "microcat")
    pairs = interactions(spark, d).select("item_id", "category").distinct().join(own, "item_id")
    t, p, m = token_set(F.col("title")), token_set(F.col("params")), token_set(F.col("microcat"))
    got = profile.lexical_coverage(pairs, token_set(F.concat_ws(" ", "category", "title")), {"title": t, "title_microcat": F.array_union(t, m), "all": F.array_union(F.array_union(t, m), p)})
    return _rounded(got, "mean_share", "zero_percent", "all_percent")


def case_examples(spark, d):
    pairs = interactions(spark, d).join(items(spark, d).select("item_id", "loc", "price"), "item_id")
    cases = {"other_place": F.col("search_loc") != F.col("loc"), "same_place": F.col("search_loc") == F.col("loc"), "no_filters": F.col("filters") == "", "cheap": F.col("price") < 910}
    return profile.case_examples(pairs, cases, ["query_text", "search_loc", "item_id"])


def item_lookup(spark, d):
    return _rounded(items(spark, d).where("item_id = 42").select("item_id", "title", "params", "price"), "price")


def fingerprints(spark, d):
    """Rows and a digest of every table."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    return io.fingerprints(spark, [f"{d}/{n}.parquet" for n in names])


def truncation_share(spark, d):
    return _rounded(encode.truncation_share(read(spark, d, "documents"), "text", 200), "share")


def encode_texts(spark, d):
    return encode.encode(read(spark, d, "benchmark"), "item_id", "text").select("item_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


_PRICED = f"""{ITEMS_SQL}, x as (select item_id k, case when item_id % 17 = 0 then -1.0e0 when item_id % 19 = 0 then 0.0e0 when item_id % 23 = 0 then 1.0e0 else price * 10 end p, case when item_id % 11 = 0 then 5.5e0 else 4.0e0 end r,
  item_id / case when item_id % 13 = 0 then 2.0e0 else 1.0e0 end n, case when item_id % 29 = 0 then 0 else lat end lat, case when item_id % 29 = 0 then 0 else lon end lon, item_id % 3 = 0 hid, item_id % 5 = 0 forb from items)"""
_CHECKS = {"price_negative": "p < 0", "price_zero": "p = 0", "price_one": "p = 1", "price_over_1_million": "p > 1000000", "rating_outside_0_5": "not (r between 0 and 5)", "reviews_negative": "n < 0", "reviews_fractional": "n <> floor(n)", "latitude_outside_90": "abs(lat) > 90", "longitude_outside_180": "abs(lon) > 180", "zero_coordinates": "lat = 0 and lon = 0", "both_contacts_disabled": "hid and forb"}
_BUCKETS = {"-1": "p = -1", "0": "p = 0", "1": "p = 1", "2-1000": "p > 1 and p <= 1000", "1001-10000": "p > 1000 and p <= 10000", ">10000": "p > 10000"}


def _counts(cases: dict[str, str], name: str) -> str:
    return f"with {_PRICED} " + " union all ".join(f"""select 'items' dataset, '{c}' "{name}", count(*) filter (where {e}) n, round(100.0e0 * count(*) filter (where {e}) / count(*), 6) as percent from x""" for c, e in cases.items())


def _quantiles(table: str, column: str, name: str) -> str:
    x = f"{column}::double"
    qs = ", ".join(f"round(quantile_cont({x}, {p}), 6) p{int(100 * p):02d}" for p in profile.LEVELS)
    return f"""select '{name}' dataset, '{column}' "column", count({x}) n, round(min({x}), 6) min, {qs}, round(max({x}), 6) max from {table}"""


def _dist(table: str, column: str, name: str, where: str = "true") -> str:
    return f"select '{name}' dataset, {column}::varchar as value, count(*) n, round(100.0e0 * count(*) / (select count(*) from {table} where {where}), 6) as percent from {table} where {where} group by 2"


_NULLS = lambda t, cols: " union all ".join(f"""select '{t}' dataset, '{c}' "column", round(100.0e0 * count(*) filter (where {c} is null) / count(*), 6) null_percent, round(100.0e0 * count(*) filter (where trim({c}::varchar) = '') / count(*), 6) blank_percent from {t}""" for c in cols)
_NEW = f"""{LOG_SQL}, nw as (select * replace (nullif(filters, '') as filters) from log where item_id % 10 = 0), old as (select * replace (nullif(filters, '') as filters) from log where item_id % 10 <> 0)"""


def _overlap(name: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""select '{name}' as "key", count(*) n from (select distinct {k} from nw intersect select distinct {k} from old)"""


_COVER = f"""{LOG_SQL}, {ITEMS_SQL}, pr as (select distinct item_id, category from log), x as (select list_distinct({TOKENS.format("concat_ws(' ', pr.category, title)")}) q, list_distinct({TOKENS.format('title')}) t, list_distinct({TOKENS.format('microcat')}) m, list_distinct({TOKENS.format('params')}) p from pr join items using (item_id)),
s as (select len(list_intersect(q, t)) / len(q)::double a, len(list_intersect(q, list_concat(t, m))) / len(q)::double b, len(list_intersect(q, list_concat(list_concat(t, m), p))) / len(q)::double c from x)"""

QUERIES = {
    "distribution": (distribution, _dist("events", "event_type", "events")),
    "top_values": (top_values, " union all ".join(f"select * from ({_dist('documents', c, c)} order by n desc, value limit 10)" for c in ("source", "lang"))),
    "quantiles": (quantiles, _quantiles("events", "value", "events") + " union all " + _quantiles("documents", "n_chars", "documents")),
    "integrity": (integrity, " union all ".join(f"select '{t}' dataset, count(*) n_rows, count(*) - (select count(*) from (select distinct {k}{', text' if t in ('documents', 'benchmark') else ''} from {t})) duplicate_rows, count(*) filter (where {k} is null) null_ids, count(*) filter (where not regexp_matches({k}::varchar, '{ID_PATTERN}')) malformed_ids, count(distinct {k}) unique_ids from {t}" for t, k in TABLES.items())),
    "conflicts": (conflicts, "with k as (select l_partkey, count(distinct l_returnflag) a, count(distinct l_linestatus) b, count(distinct l_linenumber) c from lineitem group by 1) " + " union all ".join(f"""select '{n}' "column", count(*) filter (where {c} > 1) conflicting_keys from k""" for n, c in (("l_returnflag", "a"), ("l_linestatus", "b"), ("l_linenumber", "c")))),
    "missingness": (missingness, _NULLS("documents", ["doc_id", "text", "lang", "source", "n_chars"]) + " union all " + _NULLS("conversations", ["conv_id", "turn", "role", "text"])),
    "anomalies": (anomalies, _counts(_CHECKS, "check")),
    "price_buckets": (price_buckets, _counts(_BUCKETS, "bucket")),
    "negative_prices": (negative_prices, f"with {_PRICED} " + _dist("x", "p", "items", "p < 0")),
    "query_shift": (query_shift, f"with {LOG_SQL} select case when item_id % 10 = 0 then 'late' else 'early' end part, count(*) n, round(100 * avg((filters = '')::int), 6) empty_filters, round(100 * avg((category like 'ECONOMY%')::int), 6) economy, count(distinct search_loc) places from log group by 1"),
    "overlap_seen": (overlap_seen, f"with {_NEW} " + " union all ".join(_overlap(n, k) for n, k in {"text": ["query_text"], "text_place": ["query_text", "search_loc"], "context": CONTEXT_KEYS, "item": ["item_id"]}.items())),
    "oracle_ceilings": (oracle_ceilings, f"with {CONTEXTS_SQL}, {ITEMS_SQL}, c as (select query_id, search_loc, category, unnest(item_ids) item_id from contexts), p as (select query_id, count(*) n, count(*) filter (where search_loc = loc) l, count(*) filter (where c.category = i.category) k from c left join items i using (item_id) group by 1) select round(avg(least(2, n) / n::double), 6) unfiltered, round(avg(least(2, l) / n::double), 6) same_location, round(avg(least(2, k) / n::double), 6) same_category from p"),
    "supply": (supply, f"with {CONTEXTS_SQL}, {ITEMS_SQL} " + " union all ".join(f"select '{s}' scope, count(*) filter (where coalesce(n, 0) = 0) as none, count(*) filter (where coalesce(n, 0) < 50) under_50, median(coalesce(n, 0))::double median, min(coalesce(n, 0)) min, max(coalesce(n, 0)) max from contexts left join (select {i} k, count(*) n from items group by 1) on k = {q}" for s, q, i in (("location", "search_loc", "loc"), ("category", "category", "category")))),
    "popularity": (popularity, f"with {LOG_SQL} select query_text, count(*) n, count(distinct item_id) n_items, count(distinct search_loc) n_places from log group by 1"),
    "popularity_mass": (popularity_mass, f"with {LOG_SQL}, p as (select query_text, count(*) n, count(distinct search_loc) c from log group by 1) select count(*) texts, sum(n)::bigint n_rows, count(*) filter (where c > 1) multi_place, round(100.0e0 * (select sum(n) from (select n from p order by n desc, query_text limit 10)) / sum(n), 6) top_percent from p"),
    "match_rates": (match_rates, f"with {LOG_SQL}, {ITEMS_SQL} select 'rows' unit, count(*) n, round(100 * avg(coalesce(search_loc = loc, false)::int), 6) same_place_percent from log left join items using (item_id) union all select 'unique_pairs', count(*), round(100 * avg(coalesce(search_loc = loc, false)::int), 6) from (select distinct query_text, search_loc, item_id from log) left join items using (item_id)"),
    "positives_per_context": (positives_per_context, f"with {CONTEXTS_SQL}, s as (select len(item_ids) positives from contexts) " + _quantiles("s", "positives", "contexts")),
    "location_cardinalities": (location_cardinalities, f"with {ITEMS_SQL}, {LOG_SQL} select 'items' dataset, count(distinct loc) places from items union all select 'searches', count(distinct search_loc) from log union all select 'suppliers', count(distinct s_nationkey) from supplier"),
    "text_lengths": (text_lengths, " union all ".join(f"select '{t}' dataset, count(*) n, round(avg(length(coalesce({c}, ''))), 6) mean_chars, count(distinct {k}) - count(distinct coalesce({c}, '')) extra_keys, count(*) filter (where regexp_matches({c}, '<[a-zA-Z/][^>]*>')) with_markup, count(*) filter (where length({c}) > 2000) over_2000 from {t}" for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html")))),
    "histogram_log": (histogram_log, "select floor(log10(n_chars) / 0.25e0)::bigint bin, count(*) n from documents where n_chars > 0 and log10(n_chars) < 6 group by 1"),
    "histogram": (histogram, "select floor(p_size / 5.0e0)::bigint bin, count(*) n from part where p_size >= 0 and p_size < 50 group by 1"),
    "lexical_coverage": (lexical_coverage, f"with {_COVER} " + " union all ".join(f"select '{n}' as fields, round(avg({c}), 6) mean_share, round(100 * avg(({c} = 0)::int), 6) zero_percent, round(100 * avg(({c} = 1)::int), 6) all_percent from s" for n, c in (("title", "a"), ("title_microcat", "b"), ("all", "c")))),
    "case_examples": (case_examples, f"""with {LOG_SQL}, {ITEMS_SQL}, x as (select query_text, search_loc, item_id, loc, price, filters from log join items using (item_id)), c as (select distinct query_text, search_loc, item_id, 'other_place' as "case" from x where search_loc <> loc union all select distinct query_text, search_loc, item_id, 'same_place' from x where search_loc = loc
  union all select distinct query_text, search_loc, item_id, 'no_filters' from x where filters = '' union all select distinct query_text, search_loc, item_id, 'cheap' from x where price < 910)
select *, row_number() over (partition by "case" order by query_text, search_loc, item_id) rn from c qualify rn <= 5"""),
    "item_lookup": (item_lookup, f"with {ITEMS_SQL} select item_id, title, params, round(price, 6) price from items where item_id = 42"),
    "fingerprints": (fingerprints, None),
    "truncation_share": (truncation_share, r"select count(*) n, round(avg((len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')) > 200)::int), 6) as share from documents"),
    "encode_texts": (encode_texts, r"""with words as (select item_id, unnest(string_split_regex(trim(lower(coalesce(text, ''))), '\s+')) w from benchmark), grams as (select item_id, w g from words where w <> '' union all select item_id, substr(w, k, 3) from words, range(1, 200) t(k) where k + 2 <= length(w)),
hashed as (select item_id, ('0x' || substr(md5(g), 1, 8))::ubigint h from grams), cells as (select item_id, h % 64 pos, sum(case when h >= 2147483648 then 1 else -1 end)::double v from hashed group by 1, 2), norms as (select item_id, sqrt(sum(v * v)) n from cells group by 1)
select item_id, list(round((coalesce(v, 0) / greatest(coalesce(n, 0), 1e-12))::float::double, 6) order by p.pos) embedding from benchmark cross join range(64) p(pos) left join cells using (item_id, pos) left join norms using (item_id) group by 1"""),
}
