"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (its last passage may be shorter). Each
passage is described by averages of its words' shapes, a hashed bag of word endings and its
repetitions, and encoded by a learned tanh layer. Gated attention, softmax of
w . (tanh(V h) * sigmoid(U h)), weighs the passages, and a logistic layer scores the weighted
representation. Encoder, gates and scorer are learned together from document labels by Adam.

The model is fitted on a sample of whole labelled documents: those with the least hash of their id,
at most ``SAMPLE`` of them and at most ``PASSAGES`` passages together (a document that would go
beyond that is passed over). The driver gets the descriptions of all their passages, and everything is
scored with all passages. Class weights aren't used, so a score is a probability.

Defined results: a null or empty text is one passage of zeros and gets that bag's score; without
labels of both kinds every score is the share of label 1 among the labels (0.5 without any); a
document with labels of both kinds teaches nothing, nor does one without an id; of several texts with one
id the one with the least hash teaches; rows with the same doc_id are kept apart in what is scored; a very
long text is scored whole; an empty table gives an empty result; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import common

PASSAGE = 64
SAMPLE, PASSAGES = 4096, 1 << 18
THRESHOLD = 0.3
BUCKETS = 16
HIDDEN, GATE, EPOCHS = 16, 8, 60

_SHAPES = (r"\p{L}", r"\p{Lu}", r"\p{N}", r"[.,;:]", r"[!?]", r"[#*$%&|<>@_/\\{}\[\]=+~^]")
WIDTH = 5 + len(_SHAPES) * 2 + BUCKETS + 3


def word_features(distinct: pa.Array) -> np.ndarray:
    """A row of shape features for each distinct word."""
    n = len(distinct)
    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.float32)
    cols = [np.ones(n, np.float32), np.minimum(chars, 40) / 10, chars == 1, chars > 20]
    counted = [pc.count_substring_regex(distinct, s).to_numpy(zero_copy_only=False).astype(np.float32) for s in _SHAPES]
    cols += [c / np.maximum(chars, 1) for c in counted] + [c > 0 for c in counted]
    cols.append((counted[1] == counted[0]) & (counted[0] > 1))
    ending = pc.utf8_slice_codeunits(pc.utf8_lower(distinct), -2, None)
    code, ends = common.coded(ending)
    hashed = common.string_hashes(ends)[code] if n else np.zeros(0, np.uint64)
    bag = np.zeros((n, BUCKETS), np.float32)
    bag[np.arange(n), (hashed % np.uint64(BUCKETS)).astype(np.int64)] = np.where(hashed >> np.uint64(63), -1, 1)
    return np.column_stack([*(np.asarray(c, np.float32) for c in cols), bag]).astype(np.float32)


def passages(text: pa.Array, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Descriptions of all passages in order, and how many each text has (at least one)."""
    flat, counts = common.words(text)
    codes, distinct = common.coded(flat)
    n = np.maximum(1, -(-counts // size))
    row = common.owners(n)
    k = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    sizes = np.clip(counts[row] - k * size, 0, size)
    shape = word_features(distinct)
    out = np.zeros((len(row), WIDTH), np.float32)
    for part in range(0, len(row), 4096):  # bounds the words' features held at once
        own = sizes[part : part + 4096]
        start = int(sizes[:part].sum())
        mine = codes[start : start + int(own.sum())]
        out[part : part + 4096, : shape.shape[1]] = common.segment_sums(shape[mine], own) / np.maximum(own, 1)[:, None]
    owner = common.owners(sizes)
    distinct_words = np.bincount(np.unique(owner * max(len(distinct), 1) + codes) // max(len(distinct), 1), minlength=len(row))
    same = np.zeros(len(codes), np.float32)
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    out[:, -3] = distinct_words / np.maximum(sizes, 1)
    out[:, -2] = common.segment_sums(same, sizes) / np.maximum(sizes, 1)
    out[:, -1] = sizes / size
    return out, n


class GatedAttention:
    """Encoder, gated attention and scorer; ``base`` is the score where nothing could be learned."""

    def __init__(self, seed: int = 7, base: float = 0.5):
        r = np.random.default_rng(seed)
        self.base, self.mean, self.scale, self.ready = base, np.zeros(WIDTH), np.ones(WIDTH), False
        self.p = {
            "E": r.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": r.normal(0, GATE**-0.5, GATE), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        p, row = self.p, common.owners(n)
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, np.cumsum(n) - n)[row])
        a /= common.segment_sums(a, n)[row]
        z = common.segment_sums(h * a[:, None], n)
        y = 1 / (1 + np.exp(-(z @ p["c"] + p["b"])))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "row": row}

    def gradient(self, x: np.ndarray, n: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, n)
        d = (f["y"] - label) / len(n)
        dz = d[:, None] * p["c"]
        da = (dz[f["row"]] * f["h"]).sum(axis=1)
        da = f["a"] * (da - common.segment_sums(f["a"] * da, n)[f["row"]])
        dt, ds = da[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), da[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (dz[f["row"]] * f["a"][:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ da, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, n: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01, decay: float = 1e-3) -> GatedAttention:
        self.base = float(label.mean()) if len(label) else 0.5
        if len(np.unique(label)) < 2:
            return self
        self.mean, self.scale, self.ready = x.mean(axis=0), x.std(axis=0) + 1e-3, True
        x = ((x - self.mean) / self.scale).clip(-8, 8)
        r, starts, step = np.random.default_rng(11), np.cumsum(n) - n, 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(n))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                rows = np.concatenate([np.arange(starts[i], starts[i] + n[i]) for i in own])
                step, now = step + 1, rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for name, g in self.gradient(x[rows], n[own], label[own]).items():
                    g = g + decay * self.p[name]
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(n), self.base)
        return self.forward(((x - self.mean) / self.scale).clip(-8, 8), n)["y"]


def _described(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        x, n = passages(common.texts(batch), size)
        rows = [x[e - k : e].astype("<f4").tobytes() for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), batch.column("h"), pa.array(n), pa.array(rows, pa.binary())], names=["doc_id", "quality", "h", "n", "bag"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = PASSAGE, most: int = PASSAGES) -> GatedAttention:
    """Learn from the labelled rows of ``docs``; see the module's notes on the bounds."""
    spark = docs.sparkSession
    common.tune(spark)
    one = F.min("quality") == F.max("quality")
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one.alias("agreed"), F.min("quality").cast("int").alias("quality")).where("agreed").drop("agreed")
    # the sample is chosen by ids alone; only then are its texts read
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = chosen.collect()
    known = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in rows], "doc_id long, quality int")
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(known), "doc_id")  # at most ``sample`` ids
    each = source.mapInArrow(lambda it: _described(it, size), "doc_id long, quality int, h long, n long, bag binary")
    bags = common.table(each.groupBy("doc_id", "quality").agg(F.min_by(F.struct("n", "bag"), "h").alias("b")).select("doc_id", "quality", "b.*"), "bags")
    lengths, taken, total = {r["doc_id"]: r["n"] for r in bags.select("doc_id", "n").collect()}, [], 0
    for i in (r["doc_id"] for r in rows):
        if i in lengths and total + lengths[i] <= most:
            taken.append(i)
            total += lengths[i]
    got = bags.where(F.col("doc_id").isin(taken)).toArrow().sort_by("doc_id")
    common.drop_tables(bags)
    held = [np.frombuffer(b, "<f4").reshape(-1, WIDTH) for b in got["bag"].to_pylist()]
    n = np.array([len(b) for b in held], np.int64)
    x = np.concatenate(held).astype(np.float64) if held else np.zeros((0, WIDTH))
    return GatedAttention().fit(x, n, got["quality"].to_numpy().astype(np.float64))


def predict(docs: DataFrame, model: GatedAttention, size: int = PASSAGE, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score under ``name`` (such a column of ``docs`` is replaced)."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)

    def run(batches):
        for batch in common.slices(batches, limit=common.SLICE_BYTES // 2):
            y = held.value.score(*passages(common.texts(batch), size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(y, 0, 1))], names=[*batch.schema.names, name])

    common.tune(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
