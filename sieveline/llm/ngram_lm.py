"""Language-model scores from a weighted backoff automaton over word n-grams.

Counting. A pass over the texts writes them as batches of word codes, each with its distinct word
hashes and their counts in training texts; texts are neither shuffled nor split into words again.
Each batch sends its distinct words, pairs and triples, cut into ranges of the hash, to one group
for each range, which adds them up over all batches and sends the totals back; so every batch gets
the exact count of each of its n-grams, and no task holds more than a range or a batch. Words are
told apart by 64-bit hashes, pairs and triples by ``SPARE_BITS`` bits more than it takes to number the
corpus' words (64 at most), so about one in a million clashes with another at any size.

The automaton. An n-gram is kept when it occurs at least ``LEAST`` times in training texts,
whatever the size of the corpus, and nothing bounds how many are kept. An arc for a kept n-gram
has its absolutely discounted probability; a failure arc leads to the longest shorter context and
weighs what is left, so the probabilities after every context add up to one. The empty context has
the add-one unigram distribution over all words, rare and unseen ones included. What a failure arc
weighs is a ratio of sums over all kept n-grams that begin with its context. One batch owns each
n-gram and adds it to its context; ranges of contexts add the batches' parts up and send them back.
So each batch has the arcs that its own texts pass, and the automaton is never in one place.

Scoring goes through each text from left to right, from the state of a text's start to its end
token, and adds up the log10 probabilities of the arcs and failures on the way.

Defined results: a null text is an empty one and has just the end token; without training texts
all counts are 0 and every token has probability 1; a null doc_id is held out (it teaches
nothing) and scored; repeated rows count each; an empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import common

#: Occurrences in training texts that a kept n-gram must have.
LEAST = 2
DISCOUNT = 0.5
#: Bytes of text in a batch, and words of all texts for each range of n-gram hashes. A batch sends a row
#: to each range, so larger ones make fewer rows of a large corpus and need more memory in a task.
BATCH_BYTES = 4 << 20
RANGE_WORDS = 1 << 21
SPARE_BITS = 20
END = np.uint64(xxhash.xxh3_64_intdigest("\x01end"))


def tokens(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Codes of all words, the distinct words, their hashes, and words for each text."""
    flat, counts = common.words(pc.ascii_lower(text))
    codes, distinct = common.coded(flat)
    return codes, distinct, common.string_hashes(distinct), counts


def _sequence(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All texts' words in order, each text between two end tokens (0), with -2 between texts."""
    n = counts + 3
    out = np.full(int(n.sum()), -2, np.int64)
    ends = np.cumsum(n)
    out[ends - n] = 0
    out[ends - 2] = 0
    keep = np.ones(len(out), bool)
    keep[ends - n] = keep[ends - 2] = keep[ends - 1] = False
    out[keep] = ids
    return out


@dataclass
class Ngrams:
    """The n-grams of a batch; words are numbered from 1 in the order of their hashes, 0 is the end token.

    ``pair_at`` and ``triple_at`` number the pair and the triple that start at each place of the sequence
    (-1: none). ``first`` and ``second`` are a pair's words; ``head`` and ``tail`` a triple's pairs.
    """

    words: np.ndarray
    seq: np.ndarray
    pair_at: np.ndarray
    first: np.ndarray
    second: np.ndarray
    pairs: np.ndarray
    triple_at: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    triples: np.ndarray


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return common.mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _numbered(codes: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each place's code among the distinct ones (-1 where not ``ok``), their values and first places."""
    at = np.full(len(codes), -1, np.int64)
    values, place, at[ok] = np.unique(codes[ok], return_index=True, return_inverse=True)
    return at, values, np.flatnonzero(ok)[place]


def ngrams(codes: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> Ngrams:
    seq, n, words = _sequence(codes.astype(np.int64) + 1, lengths), len(hashes) + 1, np.concatenate([[END], hashes])
    pair_at, pair, _ = _numbered(seq[:-1] * n + seq[1:], (seq[:-1] >= 0) & (seq[1:] >= 0))
    first, second = pair // n, pair % n
    pairs = _joined(words[first], words[second])
    triple_at, triple, place = _numbered(pair_at[:-1] * n + seq[2:], (pair_at[:-1] >= 0) & (pair_at[1:] >= 0))
    head, tail = triple // n, pair_at[place + 1]
    return Ngrams(words, seq, pair_at, first, second, pairs, triple_at, head, tail, _joined(pairs[head], words[triple % n]))


_zip: list = []


def _codec() -> list:
    """A worker's compressor and decompressor."""
    if not _zip:
        _zip.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return _zip


def _blob(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, its elements' first bytes before their second ones and so on."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return _codec()[0].compress(planes.tobytes())


def _array(blob: bytes, kind: str) -> np.ndarray:
    raw, size = _codec()[1].decompress(blob), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).reshape(-1).view(kind)


def _by_use(counts: np.ndarray) -> np.ndarray:
    """Words from the most to the least used: numbered so, codes are small and compress well."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _codes(row: dict) -> np.ndarray:
    """A batch's words in order, numbered in the order of their hashes."""
    return _by_use(_array(row["counts"], "<u4"))[_array(row["codes"], "<u4")]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _fields(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


_ENCODED = "batch long, n_words long, n_tokens long, n_train long, doc_ids binary, id_nulls binary, held_out binary, lengths binary, codes binary, hashes binary, counts binary"


def _encoded(batches: Iterator[pa.RecordBatch], batch_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of texts as codes of their distinct words, which are in the order of their hashes."""
    from pyspark import TaskContext

    name = TaskContext.get().partitionId() << 32
    for batch in common.slices(batches, limit=batch_bytes):
        codes, _, h, counts = tokens(common.texts(batch))
        h, at = np.unique(h, return_inverse=True)
        codes = at[codes].astype("<u4")
        doc_id, held = batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False)
        learnt = ~held
        uses = np.bincount(codes[np.repeat(learnt, counts)], minlength=len(h)).astype("<u4")
        place = np.empty(len(h), "<u4")
        place[_by_use(uses)] = np.arange(len(h), dtype="<u4")
        row = {
            "batch": name, "n_words": len(codes) + len(counts), "n_tokens": int(uses.sum()), "n_train": int(learnt.sum()),
            "doc_ids": _blob(pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False).astype("<i8")), "id_nulls": _blob(doc_id.is_null().to_numpy(zero_copy_only=False)),
            "held_out": _blob(held), "lengths": _blob(counts.astype("<i8")), "codes": _blob(place[codes]), "hashes": _blob(h), "counts": _blob(uses),
        }
        yield pa.RecordBatch.from_pylist([row], schema=_fields(_ENCODED))
        name += 1
        common.release()


_PARTS = "batch long, part int, hashes binary, a binary, b binary"


def _cuts(h: np.ndarray, parts: int) -> list[int]:
    return np.searchsorted((h >> np.uint64(32)).astype(np.int64) * parts >> 32, np.arange(parts + 1)).tolist()


@dataclass(frozen=True)
class Ranges:
    """How many ranges hashes are cut into, and how many low bits of a pair's or triple's don't count."""

    n: int
    shift: int


def ranges(words: int, range_words: int = RANGE_WORDS) -> Ranges:
    return Ranges(max(1, -(-words // range_words)), max(0, 64 - SPARE_BITS - words.bit_length()))


def _part_rows(batch: int, kind: int, parts: Ranges, h: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows for the ranges of ascending hashes and the values that go with them."""
    cuts = _cuts(h, parts.n)
    h = h >> np.uint64(parts.shift if kind else 0)
    rows = [
        {"batch": batch, "part": kind * parts.n + r, "hashes": _blob(np.diff(h[i:j], prepend=np.uint64(0))), "a": _blob(a[i:j]), "b": None if b is None else _blob(b[i:j])}
        for r, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j
    ]
    return pa.RecordBatch.from_pylist(rows, schema=_fields(_PARTS))


def _ngram_parts(batches: Iterator[pa.RecordBatch], parts: Ranges) -> Iterator[pa.RecordBatch]:
    """The words (kind 0), pairs (1) and triples (2) of each batch and their counts in training texts."""
    for batch in batches:
        for row in _rows(batch):
            lengths = _array(row["lengths"], "<i8")
            g = ngrams(_codes(row), _array(row["hashes"], "<u8"), lengths)
            learnt = np.repeat(~_array(row["held_out"], "?"), lengths + 3)
            yield _part_rows(row["batch"], 0, parts, g.words[1:], _array(row["counts"], "<u4"))
            for kind, h, at in ((1, g.pairs, g.pair_at), (2, g.triples, g.triple_at)):
                n = np.bincount(at[(at >= 0) & learnt[: len(at)]], minlength=len(h)).astype("<u4")
                order = np.argsort(h)
                yield _part_rows(row["batch"], kind, parts, h[order], n[order])
            common.release()


_TOTALS = "batch long, part int, a binary, b binary, n_known long"


def _distinct(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The distinct hashes of a range, their first places, each place's number, and the batches' runs."""
    each = [np.cumsum(_array(b, "<u8"), dtype=np.uint64) for b in group["hashes"].to_pylist()]
    h, first, at = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
    ends = np.cumsum([len(x) for x in each]).tolist()
    return h, first, at, [(b, e - len(x), e) for b, x, e in zip(group["batch"].to_pylist(), each, ends, strict=True)]


def _sums(blobs: pa.ChunkedArray, kind: str, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=np.concatenate([_array(b, kind) for b in blobs.to_pylist()]), minlength=n).astype("<i8")


def _range_totals(group: pa.Table, parts: int) -> pa.Table:
    """Totals of a range's n-grams for each batch, twice the count and one more for the batch that owns the n-gram.

    A row of batch -1 has the number of known words.
    """
    h, first, at, runs = _distinct(group)
    n, part = _sums(group["a"], "<u4", at, len(h)), group["part"][0].as_py()
    out = 2 * n[at]
    out[first] += 1
    rows = [{"batch": b, "part": part, "a": _blob(out[i:j]), "b": None, "n_known": 0} for b, i, j in runs]
    rows.append({"batch": -1, "part": part, "a": None, "b": None, "n_known": int((n > 0).sum()) if part < parts else 0})
    common.release()
    return pa.Table.from_pylist(rows, schema=_fields(_TOTALS))


def _context_totals(group: pa.Table) -> pa.Table:
    """Both sums of a range's contexts for each batch."""
    h, _, at, runs = _distinct(group)
    a, b = (_sums(group[c], "<i8", at, len(h))[at] for c in ("a", "b"))
    part = group["part"][0].as_py()
    rows = [{"batch": k, "part": part, "a": _blob(a[i:j]), "b": _blob(b[i:j]), "n_known": 0} for k, i, j in runs]
    common.release()
    return pa.Table.from_pylist(rows, schema=_fields(_TOTALS))


def _by_kind(totals: pa.Table, column: str, parts: int, kinds: int) -> list[np.ndarray]:
    """What came back for a batch, of each kind in the order in which it was sent."""
    got: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(kinds)]
    for r in totals.select(["part", column]).sort_by("part").to_pylist():
        got[r["part"] // parts].append(_array(r[column], "<i8"))
    return [np.concatenate(x) for x in got]


_DOCS = "doc_ids binary, id_nulls binary, held_out binary, n_tokens binary, n_known binary, base binary, known binary, n_refs binary, refs binary"
_PLANNED = f"batch long, {_DOCS}, {', '.join(f'{c}{k} binary' for k in '01' for c in ('hashes', 'above', 'below', 'uses', 'base_uses'))}"


def _planned(batch: pa.Table, totals: pa.Table, parts: int, ends: int, scale: float, least: int) -> pa.Table:
    """Texts with the sums of their arcs and the contexts that they fall from, and the batch's parts of contexts' sums.

    A context's sums are twice the discounted counts of the kept n-grams that begin with it (above) and
    what their words have in the shorter context (below): count + 1 for words, twice the discounted count for pairs.
    """
    out, got = [], _by_kind(totals, "a", parts, 3)
    for row in batch.to_pylist():
        lengths, held = _array(row["lengths"], "<i8"), _array(row["held_out"], "?")
        g = ngrams(_codes(row), _array(row["hashes"], "<u8"), lengths)
        c1 = np.concatenate([[ends], got[0] >> 1])
        c2, c3, own2, own3 = (np.empty(len(x), np.int64) for x in (g.pairs, g.triples, g.pairs, g.triples))
        for h, c, own, back in ((g.pairs, c2, own2, got[1]), (g.triples, c3, own3, got[2])):
            order = np.argsort(h)
            c[order], own[order] = back >> 1, back & 1
        kept1, kept2, kept3 = (c >= least for c in (c1, c2, c3))
        kept1[0] = True
        # contexts' sums over the n-grams that this batch owns
        mine2, mine3 = np.flatnonzero(kept2 & (own2 > 0)), np.flatnonzero(kept3 & (own3 > 0))
        add = lambda at, v, n: np.bincount(at, weights=v, minlength=n).astype("<i8")
        above = [add(g.first[mine2], 2 * c2[mine2] - 1, len(c1)), add(g.head[mine3], 2 * c3[mine3] - 1, len(c2))]
        below = [add(g.first[mine2], c1[g.second[mine2]] + 1, len(c1)), add(g.head[mine3], 2 * c2[g.tail[mine3]] - 1, len(c2))]
        # every token: its pair, the triple that ends with it (-1 for a text's first token), its word
        place = np.flatnonzero(g.pair_at >= 0)
        pair, word = g.pair_at[place], g.seq[place + 1]
        triple = np.concatenate([[-1], g.triple_at])[place]
        head = np.where(triple >= 0, g.head[triple], -1) if len(c3) else np.full(len(place), -1)
        by3 = (triple >= 0) & (kept3[triple] if len(c3) else False)
        by2 = ~by3 & kept2[pair]
        by1 = ~by3 & ~by2
        log1 = np.log10((c1 + 1) / scale)
        logs = log1[word]
        logs[by2] = np.log10((c2[pair[by2]] - DISCOUNT) / c1[g.first[pair[by2]]])
        if by3.any():
            logs[by3] = np.log10((c3[triple[by3]] - DISCOUNT) / c2[head[by3]])
        falls = [by1 & kept1[g.first[pair]], ~by3 & (head >= 0) & kept2[head]]
        context = [g.first[pair], head]
        n = lengths + 1
        record = {
            "batch": row["batch"], "doc_ids": row["doc_ids"], "id_nulls": row["id_nulls"], "held_out": row["held_out"], "n_tokens": _blob(n),
            "n_known": _blob(common.segment_sums((c1[word] > 0).astype(np.int64), n).astype("<i8")), "base": _blob(common.segment_sums(log1[word], n)), "known": _blob(common.segment_sums(logs, n)),
        }
        refs, base = [], 0
        for k, h in enumerate((g.words, g.pairs)):
            used = above[k] > 0
            used[context[k][falls[k]]] = True
            chosen = np.flatnonzero(used)
            chosen = chosen[np.argsort(h[chosen])]
            number = np.full(len(h) + 1, -1, np.int64)
            number[chosen] = base + np.arange(len(chosen))
            refs.append(np.where(falls[k], number[context[k]], -1))
            base += len(chosen)
            own = (c1[chosen], np.zeros(len(chosen), np.int64)) if k == 0 else (c2[chosen], c1[g.second[chosen]])
            for name, values in (("hashes", h), ("above", above[k]), ("below", below[k])):
                record[f"{name}{k}"] = _blob(values[chosen])
            record[f"uses{k}"], record[f"base_uses{k}"] = _blob(own[0].astype("<i8")), _blob(own[1].astype("<i8"))
        both = np.stack(refs, axis=1).reshape(-1)
        record["refs"] = _blob(both[both >= 0].astype("<u4"))
        record["n_refs"] = _blob(common.segment_sums((falls[0].astype(np.int64) + falls[1]), n).astype("<i8"))
        out.append(pa.RecordBatch.from_pylist([record], schema=_fields(_PLANNED)))
    common.release()
    return pa.Table.from_batches(out, schema=_fields(_PLANNED))


def _context_parts(batches: Iterator[pa.RecordBatch], parts: Ranges) -> Iterator[pa.RecordBatch]:
    """The contexts of each batch (kind 0 words, 1 pairs) with its parts of their sums."""
    for batch in batches:
        for row in _rows(batch):
            for k in (0, 1):
                yield _part_rows(row["batch"], k, parts, _array(row[f"hashes{k}"], "<u8"), _array(row[f"above{k}"], "<i8"), _array(row[f"below{k}"], "<i8"))
            common.release()


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(batch: pa.Table, totals: pa.Table, parts: int, train_tokens: int, scale: float) -> pa.Table:
    out = []
    above, below = (_by_kind(totals, c, parts, 2) for c in ("a", "b"))
    for row in batch.to_pylist():
        weights = []
        for k in (0, 1):
            uses, shorter = 2.0 * _array(row[f"uses{k}"], "<i8"), 2.0 * _array(row[f"base_uses{k}"], "<i8") if k else scale
            begins = above[k] > 0
            left, low = np.where(begins, uses - above[k], 1) / np.where(begins, uses, 1), np.where(begins, shorter - below[k], 1) / np.where(begins, shorter, 1)
            weights.append(np.log10(left / low))
        fallen = common.segment_sums(np.concatenate(weights)[_array(row["refs"], "<u4")], _array(row["n_refs"], "<i8"))
        doc_ids, n = pa.array(_array(row["doc_ids"], "<i8"), mask=_array(row["id_nulls"], "?")), _array(row["n_tokens"], "<i8")
        found = [doc_ids, _array(row["held_out"], "?"), n, _array(row["n_known"], "<i8"), np.full(len(n), train_tokens), _array(row["base"], "<f8"), _array(row["known"], "<f8") + fallen]
        out.append(pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=_fields(_SCORED)))
    common.release()
    return pa.Table.from_batches(out, schema=_fields(_SCORED))


def score(docs: DataFrame, folds: int = 7, out_fold: int = 2, least: int = LEAST, batch_bytes: int = BATCH_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """Base and model scores of every row of ``docs``, learnt from rows outside one fold of the ids."""
    spark = docs.sparkSession
    common.tune(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("held_out", common.held_out(F.col("doc_id"), folds, out_fold))
    encoded = common.table(source.mapInArrow(lambda it: _encoded(it, batch_bytes), _ENCODED), "encoded")
    sums = encoded.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens"), F.sum("n_train").alias("ends")).first()
    ends, parts = sums["ends"] or 0, ranges(sums["words"] or 0, range_words)
    n = parts.n
    train_tokens = (sums["tokens"] or 0) + ends
    sent = encoded.select("batch", "held_out", "lengths", "codes", "hashes", "counts").mapInArrow(lambda it: _ngram_parts(it, parts), _PARTS)
    totals = common.table(sent.groupBy("part").applyInArrow(lambda t: _range_totals(t, n), _TOTALS), "totals")
    del sent
    common.free_shuffles(spark)
    vocabulary = (totals.agg(F.sum("n_known")).first()[0] or 0) + (ends > 0)
    scale = float(train_tokens + vocabulary + 1)
    left = encoded.select("batch", "doc_ids", "id_nulls", "held_out", "lengths", "codes", "hashes", "counts")
    right = totals.where("batch >= 0").select("batch", "part", "a")
    planned = common.table(left.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(lambda a, b: _planned(a, b, n, ends, scale, least), _PLANNED), "planned")
    common.drop_tables(encoded, totals)
    del left, right
    common.free_shuffles(spark)
    sent = planned.select("batch", *(f"{c}{k}" for k in "01" for c in ("hashes", "above", "below"))).mapInArrow(lambda it: _context_parts(it, parts), _PARTS)
    contexts = sent.groupBy("part").applyInArrow(_context_totals, _TOTALS).select("batch", "part", "a", "b")
    texts = planned.drop(*(f"{c}{k}" for k in "01" for c in ("hashes", "above", "below")))
    return texts.groupBy("batch").cogroup(contexts.groupBy("batch")).applyInArrow(lambda a, b: _scored(a, b, n, train_tokens, scale), _SCORED)
