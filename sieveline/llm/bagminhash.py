"""Near-duplicate classes by weighted MinHash over multisets of word shingles.

Signatures follow the BagMinHash idea. A shingle that occurs w times carries the discretised
weight w. Its weight axis is cut into the dyadic ranges (0,1], (1,2], (2,4], (4,8], ...; each
range has a Poisson process of its own, drawn in ascending order from the shingle's hash, and
each point falls on one signature component and on one of its range's weight levels, drawn
directly as all are equally likely; points above level w are dropped. A component keeps
its least point, so two documents agree in a component with the probability of their weighted
Jaccard similarity. Only points below a limit that nearly surely fills all components are drawn,
which makes the cost of a signature almost independent of the document's length.

Signatures are cut into bands. Documents that share a band's key are compared with a leader of
that bucket (its shortest document), exactly, by their multiset overlap; links make connected
components. Buckets that still hold several components (say, of short documents that share a
passage) are settled exactly by prefix filtering: a multiset is ordered from its rarest element,
two that overlap enough must share one of their first few, and the positions of that one bound
what they can share. So no pair that shares a bucket is lost
unless both already are in one class, no group is expanded into all its pairs, and none is
gathered in one task.

Defined results: a null text or one without words is in a class of its own; a text of fewer
than ``shingle`` words is one shingle; a very long text is compared whole; equal word sequences
are exact copies; rows with the same doc_id and the same words are copies of each other, and with
other words are judged apart; a null doc_id gets a null class and is compared with nothing; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm import common, components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 25
BAND_ROWS = 5

_M = np.uint64
_GOLDEN = _M(0x9E3779B97F4A7C15)


def shingles(flat: pa.Array, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows in order (ascending within a row), their counts, and how many each row has."""
    codes, distinct = common.coded(flat)
    hashed = common.string_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    row = common.owners(n)
    start = (ends - counts)[row] + (np.arange(len(row)) - (np.cumsum(n) - n)[row])
    out = np.full(len(row), size, np.uint64)
    for k in range(size):
        at = start + k
        inside = at < ends[row]
        word = np.where(inside, hashed[np.minimum(at, max(len(hashed) - 1, 0))], _M(0)) if len(row) else out
        out = common.mix(out * _GOLDEN + word)
    first = np.cumsum(n) - n
    for a, b in zip(first.tolist(), (first + n).tolist(), strict=True):
        out[a:b].sort()
    if not len(out):
        return out, np.zeros(0, np.int64), n
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return out[at], np.diff(np.append(at, len(out))), common.segment_sums(new.astype(np.int64), n)


def signatures(hashes: np.ndarray, weights: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """A row of ``m`` least points for each document; rows of documents without shingles are infinite."""
    out = np.full((len(n), m), np.inf)
    total = common.segment_sums(weights.astype(np.float64), n)
    row = common.owners(n)
    todo, extra = np.flatnonzero(n > 0), 3.0
    while len(todo):
        limit = np.zeros(len(n))
        limit[todo] = (np.log(m) + extra) / total[todo]
        chosen = limit[row] > 0
        part = np.full((len(n), m), np.inf) if len(todo) == len(n) else out.copy()
        _draw(part, hashes[chosen], weights[chosen], row[chosen], limit, m)
        out[todo] = part[todo]
        todo, extra = todo[np.isinf(out[todo]).any(axis=1)], extra * 2 + 3
    return out


def _draw(out: np.ndarray, hashes: np.ndarray, weights: np.ndarray, row: np.ndarray, limit: np.ndarray, m: int) -> None:
    flat = out.reshape(-1)
    low, width, node = 0, 1, 0
    while True:
        here = weights > low
        if not here.any():
            return
        h, w, r = hashes[here], weights[here], row[here]
        seed = common.mix(h + _M((node + 1) * int(_GOLDEN) % 2**64))
        bound, x, k = limit[r], np.zeros(len(h)), 0
        while len(seed):
            draw = common.mix(seed + _M(k * int(_GOLDEN) % 2**64))
            x = x - np.log(((draw >> _M(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
            live = x <= bound
            if not live.all():
                seed, x, bound, w, r, draw = seed[live], x[live], bound[live], w[live], r[live], draw[live]
            place = common.mix(draw ^ _GOLDEN)
            component = ((place >> _M(32)) * _M(m) >> _M(32)).astype(np.int64)
            if width > 1:
                level = low + 1 + (place & _M(width - 1)).astype(np.int64)
                hit = level <= w
                np.minimum.at(flat, r[hit] * m + component[hit], x[hit])
            else:
                np.minimum.at(flat, r * m + component, x)
            k += 1
        low, width, node = low + width, max(1, low + width), node + 1


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each document."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) + _M(1), (len(signature), bands)) * _GOLDEN
    for k in range(rows):
        keys = common.mix(keys + bits[:, :, k])
    return keys.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        text = common.texts(batch)
        flat, counts = common.words(text)
        h, w, n = shingles(flat, counts, size)
        keys = band_keys(signatures(h, w, n, bands * rows), bands, rows)
        full = counts > 0
        content = [xxhash.xxh3_128_digest(b" ".join(t.split())) for t in text.cast(pa.large_binary()).to_pylist()]
        content = np.frombuffer(b"".join(content), "<i8").reshape(-1, 2)
        offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].reshape(-1)))
        total = np.where(full, np.maximum(counts - size + 1, 1), 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(total), pa.array(content[:, 0]), pa.array(content[:, 1]), lists], names=["doc_id", "h", "total", "c1", "c2", "keys"])


def _overlaps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarity of the texts in ``ta`` and ``tb``."""
    for batch in common.slices(batches, "ta", common.SLICE_BYTES // 4):
        sides = []
        for c in ("ta", "tb"):
            flat, counts = common.words(common.texts(batch, c))
            h, w, n = shingles(flat, counts, size)
            sides.append((h, w, np.cumsum(n) - n, n, common.segment_sums(w, n)))
        (ha, wa, sa, na, ta), (hb, wb, sb, nb, tb) = sides
        sims = np.zeros(batch.num_rows)
        for i in range(batch.num_rows):
            a, b = slice(sa[i], sa[i] + na[i]), slice(sb[i], sb[i] + nb[i])
            _, ia, ib = np.intersect1d(ha[a], hb[b], assume_unique=True, return_indices=True)
            both = int(np.minimum(wa[a][ia], wb[b][ib]).sum())
            sims[i] = both / max(1, ta[i] + tb[i] - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims)], names=["a", "b", "sim"])


def _verified(pairs: DataFrame, involved: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of a table that overlap enough.

    A document of many pairs is dealt out by its partners, with a copy of its text for each run of them,
    so no task gets all pairs of a leader.
    """
    limit = common.hot_limit(pairs.count())
    both = pairs
    for key, other, text in (("a", "b", "ta"), ("b", "a", "tb")):
        own, on = involved.select(F.col("id").alias(key), F.col("text").alias(text)), [key]
        counts = pairs.groupBy(key).count().where(F.col("count") > limit).collect()  # at most ``HOT_KEYS``
        if counts:
            hubs = F.broadcast(pairs.sparkSession.createDataFrame([(r[key], -(-r["count"] // limit)) for r in counts], f"{key} long, runs long"))
            runs = F.coalesce("runs", F.lit(1))
            own = own.join(hubs, key, "left").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), runs - 1))).drop("runs")
            both, on = both.join(hubs, key, "left").withColumn("run", F.pmod(F.xxhash64(other), runs)).drop("runs"), [key, "run"]
        both = both.join(own, on).drop("run")
    return both.select("a", "b", "ta", "tb").mapInArrow(lambda it: _overlaps(it, size), "a long, b long, sim double").where(F.col("sim") >= similarity).select("a", "b")


def _elements(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The elements of each multiset: a shingle's occurrences are told apart by their number."""
    for batch in common.slices(batches, limit=common.SLICE_BYTES // 4):
        flat, counts = common.words(common.texts(batch))
        h, w, n = shingles(flat, counts, size)
        which = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        elements = common.mix(np.repeat(h, w) + common.mix(which.astype(np.uint64))).view(np.int64)
        total = common.segment_sums(w, n)
        row = pa.array(common.owners(total))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(row), pa.array(total).take(row), pa.array(elements)], names=["id", "total", "element"])


def _prefixes(rest: DataFrame, involved: DataFrame, size: int, similarity: float) -> DataFrame:
    """The elements (id, total, element, at) from each multiset's rarest one up to the last that two similar multisets may share first."""
    source = involved.join(rest, "id").select("id", "text")
    elements = common.table(source.mapInArrow(lambda it: _elements(it, size), "id long, total long, element long"), "elements")
    frequency = common.table(elements.groupBy("element").agg(F.count("*").alias("n")).where("n > 1"), "frequency")
    # an element of a single document comes first, as none is rarer
    rarest = Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(1)), "element")
    placed = common.keyed_join(elements, frequency, ["element"], elements.count(), "left").withColumn("at", F.row_number().over(rarest))
    least = F.ceil(F.round(F.col("total") * similarity, 6))
    prefix = common.table(placed.where((F.col("at") <= F.col("total") - least + 1) & F.col("n").isNotNull()).select("id", "total", "element", "at"), "prefix")
    common.drop_tables(elements, frequency)
    return prefix


_SIDE = ("id", "class_id", "total", "at")


def _side(rows: DataFrame, x: str) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{c}_{x}" for c in _SIDE})


def _possible(both: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes, of rows that share an element of their prefixes, that may overlap enough by its positions."""
    needed = F.ceil(F.round((F.col("total_a") + F.col("total_b")) * (similarity / (1 + similarity)), 6))
    possible = 1 + F.least(F.col("total_a") - F.col("at_a"), F.col("total_b") - F.col("at_b"))
    return both.where((F.col("class_id_a") != F.col("class_id_b")) & (possible >= needed)).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _prefix_pairs(rows: DataFrame, similarity: float, leaders: bool) -> DataFrame:
    """Pairs that share an element of their prefixes: with ``leaders``, each row and its element's first document, else all."""
    if not leaders:
        return _possible(_side(rows, "a").join(_side(rows, "b"), "element"), similarity)
    first = F.min(F.struct("at", "total", "id", "class_id"))
    partners = rows.groupBy("element").agg(first.alias("f"), F.count("*").alias("n")).select("element", "f.*", "n")
    return _possible(common.keyed_join(_side(rows, "a"), _side(partners, "b"), ["element"], rows.count()), similarity)


def _named(signed: DataFrame) -> tuple[DataFrame, bool]:
    """One row for each word sequence: id (its node), first (least doc_id and text hash), n, total and keys; whether ids are shared.

    A node is the least doc_id; where several word sequences share it, all but one are named by their digest.
    """
    named = signed.where("total > 0 and doc_id is not null")
    copies = common.table(named.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.count("*").alias("n"), F.min("total").alias("total"), F.min_by("keys", "doc_id").alias("keys")).withColumn("id", F.col("first.doc_id")), "copies")
    shared = copies.groupBy("id").agg(F.min(F.struct("c1", "c2")).alias("least"), F.count("*").alias("n")).where("n > 1")
    if shared.isEmpty():
        return copies, False
    apart = common.keyed_join(copies.withColumnRenamed("n", "rows"), shared, ["id"], copies.count(), "left")
    node = F.when(F.col("least").isNull() | (F.col("least") == F.struct("c1", "c2")), F.col("id")).otherwise(F.col("c1"))
    out = common.table(apart.select("c1", "c2", "first", F.col("rows").alias("n"), "total", "keys", node.alias("id")), "copies")
    common.drop_tables(copies)
    return out, True


def classes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and h (a hash of the text) of each row of ``docs``."""
    common.tune(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    signed = common.table(source.mapInArrow(lambda it: _signed(it, size, bands, rows), "doc_id long, h long, total long, c1 long, c2 long, keys array<long>"), "signed")
    # exact copies first: one representative for each word sequence
    copies, apart = _named(signed)
    members = copies.select("id", "total", F.explode("keys").alias("key"))
    shortest = F.min(F.struct("total", "id"))["id"].alias("leader")
    shared = common.table(members.groupBy("key").agg(shortest, F.count("*").alias("n")).where("n > 1"), "shared")
    members = common.table(common.keyed_join(members, shared, ["key"], copies.count() * bands).select("key", "id", "leader"), "members")
    reps = copies.join(members.select("id").distinct(), "id").select("id", F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"))
    involved = common.table(source.join(reps, ["doc_id", "h"]).select("id", "text").dropDuplicates(["id"]), "involved")
    tried = common.table(members.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), "pairs")
    links = common.table(_verified(tried, involved, size, similarity), "links")
    found = components.components(links)
    # buckets whose members, but for the leader that met them all, are in more than one class
    labelled = common.table(members.where("id <> leader").join(found, "id", "left").select("key", "id", F.coalesce("class_id", "id").alias("class_id")), "labelled")
    several = labelled.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    # they are settled by prefixes: against one document of each element, which merges most
    # classes, then by all pairs that may be similar and are in different classes
    rest = common.keyed_join(labelled, several, ["key"], labelled.count()).select("id").distinct()
    prefix = _prefixes(rest, involved, size, similarity)
    done = [members, links, involved, prefix, tried, labelled, shared]
    for leaders in (True, False):
        placed = common.table(prefix.join(found, "id", "left").withColumn("class_id", F.coalesce("class_id", "id")), "placed")
        pairs = common.table(_prefix_pairs(placed, similarity, leaders).join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        new = common.table(_verified(pairs, involved, size, similarity), "links")
        if not new.isEmpty():
            found = components.components(new, found)
        done += [placed, pairs, new]
    by_content = copies.join(found, "id", "left").select("c1", "c2", "n", "first", F.coalesce("class_id", "id").alias("class_id"))
    if apart:
        by_content = common.table(by_content, "nodes")
        least = by_content.groupBy("class_id").agg(F.min("first.doc_id").alias("least"), F.count("*").alias("n"))
        by_content = common.keyed_join(by_content.withColumnRenamed("n", "rows"), least, ["class_id"], copies.count()).select("c1", "c2", F.col("rows").alias("n"), F.col("least").alias("class_id"))
    by_content = common.table(by_content.select("c1", "c2", "n", "class_id"), "by_content")
    common.drop_tables(*done)
    total = copies.agg(F.sum("n")).first()[0] or 0
    worded = F.expr("total > 0 and doc_id is not null")
    out = common.keyed_join(signed.where(worded).select("doc_id", "h", "c1", "c2"), by_content, ["c1", "c2"], total).select("doc_id", "class_id", "h")
    return out.unionByName(signed.where(~worded).select("doc_id", F.col("doc_id").alias("class_id"), "h"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each class, the one of the least id and text hash, with all its columns; rows without id stay."""
    found = common.table(classes(docs, similarity, size).where("doc_id is not null"), "classes")
    stay = found.groupBy("class_id").agg(F.min(F.struct("doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.h").alias("kept_h"))
    key = docs["doc_id"].cast("long")
    out = docs.join(stay, (key == stay["kept_id"]) & (F.xxhash64(docs["text"].cast("string")) == stay["kept_h"]), "left_semi")
    # rows repeated with one id and text are copies too; looking for them reads no text
    if not found.where("doc_id = class_id").groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.where(key.isNull()))
