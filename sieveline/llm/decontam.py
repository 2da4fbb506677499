"""Benchmark decontamination by template windows and slot consistency.

Words lose their outer punctuation and case; numbers (also spelled ones) and units become typed
placeholders. In a second form of a text, capitalised words inside a sentence become name
placeholders too, so that renamed questions are found while a passage that starts in the middle
of a sentence still matches by the first form. Windows of five template words are looked up in a
hash table of the benchmark's windows. Hits of one document and item that lie on one diagonal
are aligned. Windows of the same words count as they are. Windows with replaced slots must be
consistent on their diagonal: one value of the item stands for one value of the document, as in a
question whose numbers, names or units were replaced, and, but for numbers, the other way round;
where there are several, the most frequent one holds, and just the windows that break it are
dropped. A document is contaminated by an item when what is left covers at least ``SIMILARITY`` of
the item's windows.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, each broadcast in turn, so
memory is bounded for any benchmark while every item meets every document.

Windows with fewer than two ordinary words don't find a diagonal by their template, but count like
the others on one that was found. An item of two to four words is one window of its own length.

Defined results: a null text is clean; an item all of whose windows have fewer than two ordinary
words is found by its exact words only; an item of one word is found where a document consists of
that word, as any prose holds it; an item with a null id contaminates but adds no id to the lists;
an item listed twice is found under both ids; a very long text is searched whole; rows with the same
doc_id are kept apart; an empty table or benchmark gives no findings; only doc_id, item_id and text
are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import common

WINDOW = 5
SIMILARITY = 0.8
BLOCK_BYTES = 8 << 20

# Words that become placeholders.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset(
    "mm cm km mg kg ml kb mb gb hz khz mhz ghz kwh mph kmh kph meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit volt volts watt watts".split()
)

NUMBER, UNIT, NAME = "\x01number", "\x01unit", "\x01name"
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


@dataclass
class Words:
    """Template words of a run of texts: per distinct word what it is, and codes in order."""

    codes: np.ndarray
    counts: np.ndarray
    core: list[str]
    kind: np.ndarray
    plain: np.ndarray
    exact: np.ndarray
    capital: np.ndarray
    closing: np.ndarray


def template(text: pa.Array) -> Words:
    """Words with letters or digits, their placeholders (kind 1 number, 2 unit) and hashes."""
    flat, counts = common.words(text)
    codes, distinct = common.coded(flat)
    core = pc.replace_substring_regex(distinct, _EDGE, "")
    low = pc.utf8_lower(core)
    core_list = low.to_pylist()
    digits = pc.match_substring_regex(core, r"^\p{N}[\p{N}.,:/-]*(st|nd|rd|th|%)?$").to_numpy(zero_copy_only=False)
    kind = np.fromiter((1 if d or w in NUMBERS else 2 if w in UNITS else 0 for d, w in zip(digits.tolist(), core_list, strict=True)), np.int8, len(core_list))
    h = xxhash.xxh3_64_intdigest
    exact = np.fromiter((h(w) for w in core_list), np.uint64, len(core_list))
    plain = np.where(kind == 1, np.uint64(h(NUMBER)), np.where(kind == 2, np.uint64(h(UNIT)), exact)).astype(np.uint64)
    capital = pc.match_substring_regex(core, r"^\p{Lu}\p{Ll}").to_numpy(zero_copy_only=False).astype(bool)
    closing = pc.match_substring_regex(distinct, r"[.!?:;|]\P{L}*$").to_numpy(zero_copy_only=False).astype(bool)
    empty = pc.equal(pc.binary_length(core), 0).to_numpy(zero_copy_only=False).astype(bool)
    if empty.any():
        keep = ~empty[codes]
        run = np.concatenate([[0], np.cumsum(keep)])
        ends = np.cumsum(counts)
        codes, counts = codes[keep], run[ends] - run[ends - counts]
    return Words(codes, counts, core_list, kind, plain, exact, capital, closing)


def named(w: Words) -> np.ndarray:
    """Which words in order are capitalised inside a sentence."""
    before = np.ones(len(w.codes), bool)
    before[1:] = w.closing[w.codes[:-1]]
    starts = (np.cumsum(w.counts) - w.counts)[w.counts > 0]
    before[starts] = True
    return w.capital[w.codes] & ~before


def forms_of(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the three forms (plain, with names, exact) each word's hash and whether it is a placeholder."""
    name, slot = named(w), w.kind[w.codes] > 0
    name_hash = np.uint64(xxhash.xxh3_64_intdigest(NAME))
    plain, exact = w.plain[w.codes], w.exact[w.codes]
    return [(plain, slot), (np.where(name & ~slot, name_hash, plain), slot | name), (exact, np.zeros_like(slot))]


def windows(w: Words, size: int = WINDOW) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Start of each text's windows of ``size`` words and, for each form, hashes and whether they find an item."""
    n = np.maximum(w.counts - size + 1, 0)
    row = common.owners(n)
    start = (np.cumsum(w.counts) - w.counts)[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    out = []
    for k, (values, special) in enumerate(forms_of(w)):
        key, ordinary = np.full(len(start), k + 3 * (WINDOW - size), np.uint64), np.zeros(len(start), np.int64)
        for j in range(size):
            key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + values[start + j])
            ordinary += ~special[start + j]
        out.append((key, ordinary >= 2 if k < 2 else np.ones(len(key), bool)))
    return start, out


class Benchmark:
    """A block of items with its table of window hashes."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        w = template(pa.array([t or "" for t in texts], pa.string()))
        self.ids, self.first = ids, np.cumsum(w.counts) - w.counts
        self.size = np.minimum(w.counts, WINDOW)
        self.n = np.where(w.counts > 0, w.counts - self.size + 1, 0)
        self.sizes = sorted(set(self.size[self.size > 0].tolist()))
        self.words = [w.core[c] for c in w.codes.tolist()]
        self.slot = ((w.kind[w.codes] > 0) | named(w)).tolist()
        self.number = (w.kind[w.codes] == 1).tolist()
        self.forms = [values for values, _ in forms_of(w)]
        self.item = np.searchsorted(self.first, np.arange(len(w.codes)), "right") - 1
        # items without words share their start with the next one; the last of equals has the words
        every, found, keys, at = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for size in self.sizes:
            start, forms = windows(w, size)
            own = self.size[self.item[start]] == size
            every.append(start[own])
            found.append(start[own & (forms[0][1] & forms[1][1])])
            keys += [k[ok & own] for k, ok in forms]
            at += [start[ok & own] for _, ok in forms]
        keys, at = np.concatenate(keys), np.concatenate(at)
        #: for each item the starts of windows that a template doesn't look up
        self.heavy: dict[int, list[int]] = defaultdict(list)
        for p in np.setdiff1d(np.concatenate(every), np.concatenate(found)).tolist() if every else []:
            self.heavy[int(self.item[p])].append(p)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]
        self.bits = 1 << max(16, int(len(keys) * 16).bit_length())
        self.seen = np.zeros(self.bits, bool)
        self.seen[(self.keys & np.uint64(self.bits - 1)).astype(np.int64)] = True

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index in ``keys``, item word position) of equal windows."""
        maybe = np.flatnonzero(self.seen[(keys & np.uint64(self.bits - 1)).astype(np.int64)])
        low, high = (np.searchsorted(self.keys, keys[maybe], side) for side in ("left", "right"))
        n = high - low
        index = np.repeat(maybe, n)
        return index, self.at[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _most(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """The most frequent second value of each first one; of equals one that stays the same, then the first met."""
    best: dict[str, tuple[int, bool, str]] = {}
    for (a, b), n in Counter(pairs).items():
        if a not in best or (n, a == b) > best[a][:2]:
            best[a] = (n, a == b, b)
    return {a: b for a, (_, _, b) in best.items()}


def _inconsistent(slots: dict[int, tuple[str, str, bool]]) -> set[int]:
    """Places whose slot breaks the replacement of values; ``slots``: item value, document value, whether a number."""
    there = _most([(a, b) for a, b, _ in slots.values()])
    back = _most([(b, a) for a, b, number in slots.values() if not number and there[a] == b])
    return {p for p, (a, b, number) in slots.items() if there[a] != b or not (number or back[b] == a)}


def findings(text: pa.Array, bench: Benchmark, similarity: float = SIMILARITY) -> tuple[list[list[int]], list[list[int]]]:
    """For each text the items that contaminate it, and those of them whose slots were replaced."""
    w = template(text)
    found, changed = [[] for _ in range(len(text))], [[] for _ in range(len(text))]
    parts = []
    for size in bench.sizes:
        start, forms = windows(w, size)
        row = common.owners(np.maximum(w.counts - size + 1, 0))
        whole = (w.counts == 1)[row] if size == 1 else np.ones(len(row), bool)
        for k, (keys, ok) in enumerate(forms):
            index, place = bench.hits(np.where(ok & whole, keys, np.uint64(0)))
            parts.append((row[index], start[index], place, np.full(len(index), k == 2)))
    if not parts:
        return found, changed
    row, start, place, same = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends, own = np.cumsum(w.counts), [values for values, _ in forms_of(w)]
    groups: dict[tuple[int, int], dict[int, dict[int, bool]]] = defaultdict(lambda: defaultdict(dict))
    for r, i, j, p, exact in zip(row.tolist(), bench.item[place].tolist(), start.tolist(), place.tolist(), same.tolist(), strict=True):
        diagonal = groups[r, i][j - p]
        diagonal[p] = diagonal.get(p, False) or exact
    for (r, i), diagonals in groups.items():
        n, size, heavy = int(bench.n[i]), int(bench.size[i]), bench.heavy.get(i, [])
        if len(set(heavy).union(*diagonals.values())) < similarity * n:
            continue
        covered, replaced = set(), False
        for d, at in diagonals.items():
            for p in heavy:
                if p not in at and ends[r] - w.counts[r] <= p + d and p + d + size <= ends[r]:
                    if any((a[p + d : p + d + size] == b[p : p + size]).all() for a, b in zip(own, bench.forms, strict=True)):
                        at[p] = False
            words = sorted({p + k for p in at for k in range(size)})
            both = [(p, bench.slot[p], bench.words[p], w.core[w.codes[p + d]]) for p in words]
            # ordinary words that stay the same are no slots, whatever a name beside them is replaced by
            slots = {p: (a, b, bench.number[p]) for p, slot, a, b in both if slot or a != b}
            broken = _inconsistent(slots)
            good = [p for p, exact in at.items() if exact or broken.isdisjoint(range(p, p + size))]
            covered.update(good)
            replaced |= any(q in slots and slots[q][0] != slots[q][1] for p in good for q in range(p, p + size))
        if len(covered) >= similarity * n:
            found[r].append(bench.ids[i])
            if replaced:
                changed[r].append(bench.ids[i])
    return found, changed


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Benchmark]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield Benchmark(got["item_id"].to_pylist(), got["text"].to_pylist())


def _pass(source: DataFrame, bench: Benchmark, similarity: float) -> DataFrame:
    """All columns of ``source`` with item_ids and changed_ids of one block; a null stands for items without id."""
    held = source.sparkSession.sparkContext.broadcast(bench)

    def run(batches):
        for batch in common.slices(batches):
            hits = [pa.array([sorted(set(x), key=lambda i: (i is None, i)) for x in y], pa.list_(pa.int64())) for y in findings(common.texts(batch), held.value, similarity)]
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *hits], names=[*rest.schema.names, "item_ids", "changed_ids"])

    kept = ", ".join(f"{n} long" for n in source.columns if n != "text")
    return source.mapInArrow(run, f"{kept}, item_ids array<long>, changed_ids array<long>")


def search(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, contaminated, item_ids and changed_ids (arrays, ascending) of every row of ``docs``."""
    common.tune(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(benchmark, block_bytes)
    first = next(blocks, Benchmark([], []))
    second = next(blocks, None)
    if second is None:
        found = _pass(source, first, similarity)
    else:
        # a pass for each block, of which only the hits are kept
        keyed = source.withColumn("h", F.xxhash64("text"))
        hits = [common.table(_pass(keyed, b, similarity).where("size(item_ids) > 0"), "hits") for b in (first, second, *blocks)]
        merged = hits[0]
        for more in hits[1:]:
            merged = merged.unionByName(more)
        lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("item_ids", "changed_ids")]
        merged = merged.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(*lists)
        empty = F.array().cast("array<long>")
        found = keyed.select("doc_id", "h").join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
        found = found.select("doc_id", F.coalesce("item_ids", empty).alias("item_ids"), F.coalesce("changed_ids", empty).alias("changed_ids"))
    ids = [F.array_compact(c).alias(c) for c in ("item_ids", "changed_ids")]
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), *ids)


def cleaned(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with all their columns."""
    common.tune(docs.sparkSession)
    schema = docs.schema

    def passed(source: DataFrame, bench: Benchmark) -> DataFrame:
        held = source.sparkSession.sparkContext.broadcast(bench)

        def run(batches):
            for batch in common.slices(batches):
                yield batch.filter(pa.array([not x for x in findings(common.texts(batch), held.value, similarity)[0]]))

        return source.mapInArrow(run, schema)

    blocks = _blocks(benchmark, block_bytes)
    out, block = docs, next(blocks, None)
    while block is not None:
        out, block = passed(out, block), next(blocks, None)
        if block is not None:
            out = common.table(out, "cleaned")  # one block in memory at a time
    return out
