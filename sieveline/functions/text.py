"""Text expressions: normalising, hashing, tokens, markers, filters and masking.

Java's regular expressions know only ASCII classes by default, so white space and words are
written with Unicode properties; the same patterns work in other SQL engines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\x{85}]+"
WORD = r"[\p{L}\p{N}_]+"
SEPARATOR = "\x1f"

# The keys of a filter text, those that are matched against an item's parameters with
# the feature each makes, the one whose value is matched without its key, and the parameter markers.
FILTER_KEYS = ["Тип услуги автосервиса", "Предмет или специальность", "Кто оказывает услуги", "Онлайн-запись", "Вид услуги", "Тип услуги"]
MATCH_KEYS = {"Вид услуги": "filt_vid", "Тип услуги": "filt_tip", "Тип услуги автосервиса": "filt_auto", "Предмет или специальность": "filt_subject"}
BARE_KEY = "Тип услуги автосервиса"
BOOKING_KEY = "Онлайн-запись"
PARAM_MARKERS = {"mk_online_booking": "Онлайн-запись", "mk_remote": "Удалённо", "mk_online": "Онлайн", "mk_city_trip": "Выезд по всему городу", "mk_no_trip": "Не выезжаю", "mk_price_list": "Название услуги"}


def normalize_text(text: Column) -> Column:
    """Null as empty, lower case, ё as е, runs of white space as one space, trimmed."""
    low = F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(low, SPACE, " "))


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, SPACE, " ")), F.lit(""))


def stable_hash(value: Column, seed: str) -> Column:
    """The first eight bytes of the SHA-256 of seed and value, as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}{SEPARATOR}"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def digest_id(*parts: Column) -> Column:
    """Sixteen hexadecimal digits that name the parts together; null if any is null."""
    joined = F.concat(*[x for p in parts for x in (F.lit(SEPARATOR), p.cast("string"))][1:])
    return F.substring(F.sha2(joined, 256), 1, 16)


def tokens(text: Column) -> Column:
    """All words of a text, in order, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def term_bags(docs: DataFrame, key: Column, text: Column, name: str, leave_out: frozenset[str] = frozenset(), form: Callable[[str], str] | None = None) -> DataFrame:
    """A row for each text: ``name`` (the key), dl (words), its distinct terms and how often each occurs (tfs).

    Words of ``leave_out`` don't count; with ``form`` a term is a word's form, made once for each distinct word
    of a batch. Counting in Arrow batches shuffles nothing, unlike grouping exploded words, and takes about a
    third of the time of the same with sorted arrays and lambdas.
    """
    source = docs.select(key.alias(name), F.lower(F.coalesce(text, F.lit(""))).alias("_t"))
    kind = source.schema[name].dataType.simpleString()
    return source.mapInArrow(lambda it: _bags(it, name, leave_out, form), f"`{name}` {kind}, dl long, terms array<string>, tfs array<long>")


class TermCounter:
    """Counts the words of lower-cased texts; a word's form is remembered."""

    def __init__(self, leave_out: frozenset[str] = frozenset(), form: Callable[[str], str] | None = None):
        self.out, self.form, self.known = pa.array(sorted(leave_out), pa.string()), form, {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct word of each text, by texts: the text's place, the word's code and its count; also all words by code, and the texts' lengths."""
        lists = pc.split_pattern_regex(texts, r"[^\p{L}\p{N}_]+")
        words = lists.flatten()
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        some = pc.greater(pc.binary_length(words), 0)
        coded, row = words.filter(some).dictionary_encode(), row[some.to_numpy(zero_copy_only=False)]
        terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if len(self.out) and len(terms):
            keep = ~pc.is_in(terms, self.out).to_numpy(zero_copy_only=False)[codes]
            row, codes = row[keep], codes[keep]
        if self.form is not None:
            forms = pa.array([self.known[t] if t in self.known else self.known.setdefault(t, self.form(t)) for t in terms.to_pylist()], pa.string()).dictionary_encode()
            if len(self.known) > 1 << 18:
                self.known.clear()
            terms, codes = forms.dictionary, forms.indices.to_numpy(zero_copy_only=False)[codes] if len(codes) else codes
        size = max(1, len(terms))
        pairs, tf = np.unique(row * size + codes, return_counts=True)
        return pairs // size, terms, pairs % size, tf, np.bincount(row, minlength=len(texts))


def _bags(batches: Iterator[pa.RecordBatch], name: str, leave_out: frozenset[str], form: Callable[[str], str] | None, rows: int = 512) -> Iterator[pa.RecordBatch]:
    count = TermCounter(leave_out, form)
    for whole in batches:
        for k in range(0, whole.num_rows, rows):
            batch = whole.slice(k, rows)
            row, terms, codes, tf, dl = count(batch.column("_t"))
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(dl), pa.ListArray.from_arrays(ends, terms.take(pa.array(codes))), pa.ListArray.from_arrays(ends, pa.array(tf))], names=[name, "dl", "terms", "tfs"])


def overlap(query: Column, item: Column) -> Column:
    """Share of the query's distinct tokens that the item has; 0 for an empty query."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, item)) / F.size(query))


def space_words(text: Column) -> Column:
    """Pieces between single spaces: 1 for an empty text."""
    return F.size(F.split(text, " ", -1))


def has_mixed_script(text: Column) -> Column:
    """A Latin letter beside a Cyrillic one."""
    return F.coalesce(F.lower(text).rlike("[a-z][а-яё]|[а-яё][a-z]"), F.lit(False))


def marker_columns(params: Column, markers: dict[str, str] = PARAM_MARKERS) -> list[Column]:
    """1.0 or 0.0 for each literal marker; null for null parameters."""
    return [F.contains(params, F.lit(m)).cast("double").alias(name) for name, m in markers.items()]


def parse_filters(text: Column, keys: list[str] = FILTER_KEYS) -> Column:
    """A map from each key that a filter text holds to the text up to the next key, trimmed.

    Longer keys win over shorter ones that they begin with; of a repeated key the last counts.
    """
    longest = "|".join(f"\\Q{k}\\E" for k in sorted(keys, key=lambda k: (-len(k), k)))
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"({longest})", "\x1e$1\x1d")
    parts = F.split(marked, "\x1e", -1)
    entries = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda e: F.struct(F.split_part(e, F.lit("\x1d"), F.lit(1)).alias("key"), F.trim(F.split_part(e, F.lit("\x1d"), F.lit(2))).alias("value")))
    # a map takes each key once
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    values = F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"])
    return F.map_from_arrays(names, values)


def filter_match(filters: Column, params: Column) -> dict[str, Column]:
    """For each matched key whether the parameters hold ``key value``; null where the filter is unset.

    ``filters`` is a map from :func:`parse_filters`. The booking feature asks for the key alone;
    ``filt_set`` counts the set ones and ``filt_share`` is the share of those that match.
    """
    out = {}
    for key, name in MATCH_KEYS.items():
        value = F.nullif(F.try_element_at(filters, F.lit(key)), F.lit(""))
        wanted = value if key == BARE_KEY else F.concat(F.lit(f"{key} "), value)
        out[name] = F.when(value.isNotNull(), F.contains(params, wanted).cast("double"))
    out["filt_booking"] = F.when(F.map_contains_key(filters, BOOKING_KEY), F.contains(params, F.lit(BOOKING_KEY)).cast("double"))
    own = list(out.values())
    n_set = sum((c.isNotNull().cast("double") for c in own), F.lit(0.0))
    hits = sum((F.coalesce(c, F.lit(0.0)) for c in own), F.lit(0.0))
    return out | {"filt_set": n_set, "filt_share": F.when(n_set > 0, hits / n_set)}


def mask_excerpt(text: Column, limit: int = 180) -> Column:
    """White space collapsed, addresses and long numbers as tags, at most ``limit`` characters and an ellipsis."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    out = F.regexp_replace(out, r"[^ @]+@[^ @]+[.][\p{L}\p{N}_]+", "[email]")
    out = F.regexp_replace(out, r"(^|[^\p{L}\p{N}_+])[+]?[0-9][0-9 ()-]{8,}[0-9]", "$1[number]")
    return F.concat(F.substring(out, 1, limit), F.when(F.length(out) > limit, F.lit("…")).otherwise(F.lit("")))
