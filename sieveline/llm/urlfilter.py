"""URL blocking: host and path rules, then a blocked Bloom filter before an exact hash join.

Rules: a rule names a host and a path prefix; it fits that host and all its subdomains when the
URL's path starts with the rule's. Of several that fit, the longest wins. A URL without a rule
is looked up in a list of URLs in canonical form: a blocked Bloom filter (one 512-bit block for
each URL, eight bits in it) lets possible members pass, and an exact join with the list removes
the false ones. The filter's size follows the list up to ``MAX_BLOCKS`` blocks, so what is
broadcast is bounded; a longer list only makes more false positives for the join to remove. Rows
that a rule decides or that the filter stops are not shuffled, and a URL that many pages share
doesn't gather them in one task.

Canonical form: scheme, fragment, default port and a leading ``www.`` or ``m.`` go, the host is
lower-cased, tracking parameters (``utm_*``, ``ref``) go, a path loses a final ``/``.

Defined results: a null URL has an empty host and path, no rule and verdict allow; so has one
without ``://``; a very long URL is judged whole; a URL listed twice is listed; rows with the same
page_id are kept apart; an empty list or table gives no blocks; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from sieveline.llm import common

#: (verdict, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Blocks of 64 bytes that the filter may have: 16 MB.
MAX_BLOCKS = 1 << 18
WORDS, BITS = 8, 64

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
HOST = _LOWER.format("regexp_extract(coalesce(url, ''), '^(?s:.)*?://([^/?#]*)', 1)")
PATH = "regexp_extract(coalesce(url, ''), '^(?s:.)*?://[^/?#]*([^?#]*)', 1)"
#: Steps from host, path and query to the canonical form; the same in Spark and DuckDB but for the flag of a global replacement.
QUERY = "regexp_extract(coalesce(url, ''), '^(?s:.)*?://[^?#]*[?]([^#]*)', 1)"


def canonical(replace_all: str = "regexp_replace({}, {}, {})") -> str:
    """SQL for the canonical form of ``url``, null without ``://``."""
    host = f"regexp_replace(regexp_replace({HOST}, '^(www|m)[.]', ''), ':(80|443)$', '')"
    path = f"regexp_replace({PATH}, '/$', '')"
    kept = replace_all.format(f"concat('&', {QUERY})", "'&(utm_[^=&]*|ref)(=[^&]*)?'", "''")
    query = f"regexp_replace(regexp_replace({kept}, '^&+', ''), '&+$', '')"
    return f"case when coalesce(url, '') like '%://%' then concat({host}, {path}, case when {query} = '' then '' else concat('?', {query}) end) end"


def rule_sql(host: str = "host", path: str = "path") -> tuple[str, str]:
    """SQL for the fitting rule's name and verdict: the longest first."""
    name, verdict = "case", "case"
    for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = f"when ({host} = '{h}' or {host} like '%.{h}') and {path} like '{p}%' then"
        name, verdict = f"{name} {fits} '{h}{p}'", f"{verdict} {fits} '{v}'"
    return f"{name} end", f"{verdict} end"


def build_filter(listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """The filter of the list's ``canon`` column; its size is bounded by ``max_blocks``."""
    n = listed.count()
    blocks = 1
    while blocks * BITS < n * 2 and blocks < max_blocks:
        blocks *= 2
    masks = [F.expr(f"shiftleft(1L, cast(shiftright(h2, {6 * k}) & 63 as int))") for k in range(WORDS)]
    keyed = listed.select(F.xxhash64("canon").alias("h1"), F.xxhash64(F.lit(1), "canon").alias("h2")).select(F.col("h1").bitwiseAND(F.lit(blocks - 1)).alias("block"), *(m.alias(f"m{k}") for k, m in enumerate(masks)))
    rows = keyed.groupBy("block").agg(*(F.bit_or(f"m{k}").alias(f"m{k}") for k in range(WORDS))).toArrow()
    out = np.zeros((blocks, WORDS), np.int64)
    if rows.num_rows:
        out[rows["block"].to_numpy()] = np.column_stack([rows[f"m{k}"].to_numpy() for k in range(WORDS)])
    return out


def _marked(ruled: DataFrame, filter_: np.ndarray) -> DataFrame:
    """``ruled`` with ``maybe``: no rule decides the row, and the filter lets its ``canon`` pass."""
    held = ruled.sparkSession.sparkContext.broadcast(filter_)

    def run(batches):
        for batch in batches:
            h1, h2, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_h1", "_h2", "_asked"))
            yield batch.append_column("maybe", pa.array(asked.astype(bool) & _member(held.value, h1, h2)))

    asked = F.col("verdict").isNull() & F.col("canon").isNotNull()
    keyed = ruled.withColumns({"_h1": F.xxhash64("canon"), "_h2": F.xxhash64(F.lit(1), "canon"), "_asked": asked})
    return keyed.mapInArrow(run, StructType([*keyed.schema.fields, StructField("maybe", BooleanType())])).drop("_h1", "_h2", "_asked")


def _member(filter_: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    block = filter_[h1 & (len(filter_) - 1)]
    ok = np.ones(len(h1), bool)
    for k in range(WORDS):
        ok &= (block[:, k] >> ((h2 >> (6 * k)) & 63)) & 1 == 1
    return ok


def judge(pages: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url); ``listed`` (url) is the list."""
    common.tune(pages.sparkSession)
    name, verdict = rule_sql()
    canon = F.expr(canonical())
    urls = listed.select(F.col("url").cast("string").alias("url")).select(canon.alias("canon")).where("canon is not null").distinct()
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    parts = source.select("page_id", F.expr(HOST).alias("host"), F.expr(PATH).alias("path"), canon.alias("canon"))
    ruled = parts.select("page_id", "host", "path", F.expr(name).alias("rule"), F.expr(verdict).alias("verdict"), "canon")
    marked = common.table(_marked(ruled, build_filter(urls, max_blocks)), "urls")
    # only rows that no rule decides and that the filter lets pass are joined; the join is exact, so
    # false positives go, and a URL that many pages have is joined where its rows are
    maybe = marked.where("maybe").drop("verdict", "maybe")
    counts = maybe.groupBy("canon").agg(F.count("*").alias("n"))
    known = counts.join(urls.withColumn("verdict", F.lit("block")), "canon", "left")
    looked = common.keyed_join(maybe, known, ["canon"], maybe.count(), "left")
    out = ["page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")]
    return marked.where("not maybe").select(*out).unionByName(looked.select(*out))


ORACLE = f"""
with listed as (select distinct {canonical("regexp_replace({}, {}, {}, 'g')")} canon from pages where page_id % 100 = 0),
parts as (select page_id, {HOST} host, {PATH} path, {canonical("regexp_replace({}, {}, {}, 'g')")} canon from pages),
ruled as (select *, {rule_sql()[0]} as rule, {rule_sql()[1]} ruled from parts)
select page_id, host, path, rule, coalesce(ruled, case when canon in (select canon from listed where canon is not null) then 'block' end, 'allow') verdict from ruled
"""
