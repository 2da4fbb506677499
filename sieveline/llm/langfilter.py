"""Language identification by a bit-sliced Bloom filter of character n-grams.

Training counts the n-grams of letters-only, lower-cased words in each language, over all labelled
rows. A language contains an n-gram that it was seen with at least ``LEAST`` times, at no less than
``SHARE`` of the rate of the language where the n-gram is most frequent: a foreign word now and then
doesn't make an n-gram a language's own, however large the corpus, and no n-gram is left out for
being rare. All languages share one filter: each slot holds a bit for each language, so the AND
of an n-gram's slots gives all languages that contain it at once. For a text the bits are counted
for each language, corrected for that language's rate of false positives, and the language with
the largest corrected share wins (ties: the first in alphabetical order).

The filter has ``SPACE`` to twice as many slots as n-grams. It is made of shards of at most
``SHARD_GRAMS`` n-grams, told apart by their hash, each a broadcast of bounded size; with several, the
texts are passed once for each shard and the counts add up, so nothing depends on the table's size but time.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text
when no labelled row is left to learn from; rows with a null lang or id teach nothing; repeated
rows teach as often as they occur; a very long text is judged whole; an empty table gives an empty
result; more than ``MAX_LANGUAGES`` labels are refused, as they are no languages; only doc_id, text
and lang are read, and other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from sieveline.llm import common

GRAM = 4
LEAST, SHARE = 2, 0.05
#: Slots for each n-gram (at least), n-grams of a shard (about), and its hash functions.
SPACE, SHARD_GRAMS, HASHES = 8, 1 << 19, 4
MAX_LANGUAGES = 4096
UND = "und"


@dataclass
class Shard:
    """A row of mask bytes for each slot, and how likely a slot row is to show each language by chance."""

    masks: np.ndarray
    false_rate: np.ndarray


@dataclass
class LanguageFilter:
    """Languages in order, and shards; an n-gram is in the one that its hash names."""

    languages: list[str]
    shards: list[Shard]


def letters(text: pa.Array) -> pa.Array:
    """Lower-cased text with everything but letters turned into single spaces."""
    return pc.utf8_lower(pc.replace_substring_regex(text, r"\P{L}+", " "))


def grams(distinct: pa.Array, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word between a leading space and trailing ones, and how many each has."""
    if not len(distinct):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    tail = " " * (size - 2)
    points = np.frombuffer((" " + f"{tail} ".join(distinct.to_pylist()) + tail).encode("utf-32-le"), np.uint32).astype(np.uint64)
    padded = lengths + 1 + len(tail)
    n = padded - size + 1
    starts = np.cumsum(padded) - padded
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x100000001B3) + points[at + k]
    return common.mix(out), n


def slots(hashed: np.ndarray, n_slots: int, k: int = HASHES) -> np.ndarray:
    """The k slots of each n-gram, by double hashing."""
    step = (hashed >> np.uint64(32)) | np.uint64(1)
    return ((hashed[:, None] + np.arange(k, dtype=np.uint64) * step[:, None]) % np.uint64(n_slots)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        flat, counts = common.words(letters(common.texts(batch)))
        lang, names = common.coded(batch.column("lang"))
        codes, distinct = common.coded(flat)
        hashed, n = grams(distinct, size)
        gram, uniq = np.unique(hashed, return_inverse=True)
        for k, name in enumerate(names.to_pylist()):
            uses = np.bincount(codes[(lang == k)[common.owners(counts)]], minlength=len(distinct))
            total = np.bincount(uniq, weights=np.repeat(uses, n), minlength=len(gram)).astype(np.int64)
            used = total > 0
            yield pa.RecordBatch.from_arrays([pa.array([name] * int(used.sum()), pa.string()), pa.array(gram[used].view(np.int64)), pa.array(total[used])], names=["lang", "gram", "n"])


def _shard_of(hashed: np.ndarray, n: int) -> np.ndarray:
    return ((hashed >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def build_shard(hashed: np.ndarray, bits: np.ndarray, languages: int, n_slots: int | None = None) -> Shard:
    """The filter of n-grams and, for each, a row of mask bytes."""
    n_slots = n_slots or 1 << max(10, int(SPACE * len(hashed) - 1).bit_length())
    masks = np.zeros((n_slots, bits.shape[1]), np.uint8)
    at = slots(hashed, n_slots)
    for k in range(HASHES):
        np.bitwise_or.at(masks, at[:, k], bits)
    fill = np.array([(masks[:, k // 8] >> (k % 8) & 1).mean() for k in range(languages)])
    return Shard(masks, fill**HASHES)


def kept_grams(labelled: DataFrame, size: int = GRAM, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """lang and gram of each n-gram that a language contains."""
    source = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = common.table(source.mapInArrow(lambda it: _counted(it, size), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    if totals.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    rated = counted.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))  # at most MAX_LANGUAGES rows
    # an n-gram has a row for each language at most
    most = F.max("rate").over(Window.partitionBy("gram"))
    return rated.withColumn("most", most).where((F.col("n") >= least) & (F.col("rate") >= F.col("most") * share)).select("lang", "gram")


def fit(labelled: DataFrame, size: int = GRAM, least: int = LEAST, share: float = SHARE, n_slots: int | None = None, shard_grams: int = SHARD_GRAMS) -> LanguageFilter:
    """Learn from (text, lang) rows. The driver gets the n-grams of one shard at a time."""
    common.tune(labelled.sparkSession)
    kept = common.table(kept_grams(labelled, size, least, share), "kept")
    languages = sorted(r["lang"] for r in kept.select("lang").distinct().collect())  # at most MAX_LANGUAGES
    place = {name: k for k, name in enumerate(languages)}
    distinct = kept.select("gram").distinct().count()
    n_shards, shards = max(1, -(-distinct // shard_grams)), []
    which = F.pmod(F.shiftrightunsigned("gram", 40), F.lit(n_shards))
    for s in range(n_shards if languages else 0):
        got = kept.where(which == s).toArrow()
        hashed, row = np.unique(got["gram"].to_numpy().view(np.uint64), return_inverse=True)
        codes, names = common.coded(got["lang"].combine_chunks())
        lang = np.array([place[x] for x in names.to_pylist()], np.int64)[codes]
        bits = np.zeros((len(hashed), -(-len(languages) // 8)), np.uint8)
        np.bitwise_or.at(bits, (row, lang // 8), (1 << (lang % 8)).astype(np.uint8))
        shards.append(build_shard(hashed, bits, len(languages), n_slots))
    common.drop_tables(kept)
    return LanguageFilter(languages, shards)


def hits(text: pa.Array, shard: Shard, languages: int, number: int = 0, n_shards: int = 1, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each text and language the corrected number of its n-grams in a shard, and how many it has in all shards."""
    flat, counts = common.words(letters(text))
    codes, distinct = common.coded(flat)
    hashed, n = grams(distinct, size)
    own = _shard_of(hashed, n_shards) == number
    both = np.bitwise_and.reduce(shard.masks[slots(hashed[own], len(shard.masks))], axis=1)
    bits = np.zeros((len(hashed), languages), np.float32)
    # each bit less its chance of being there by accident
    bits[own] = (np.unpackbits(both, axis=1, count=languages, bitorder="little") - shard.false_rate) / np.maximum(1 - shard.false_rate, 1e-9)
    per_word = common.segment_sums(bits.astype(np.float64), n)
    return common.segment_sums(per_word[codes], counts), common.segment_sums(n[codes], counts)


def decided(found: np.ndarray, total: np.ndarray, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text from its corrected hits."""
    if not languages:
        return [UND] * len(total), np.zeros(len(total))
    share = np.clip(np.round(found / np.maximum(total, 1)[:, None], 12), 0, 1)
    best = share.argmax(axis=1)
    score = np.where(total > 0, share[np.arange(len(total)), best], 0.0)
    return [languages[b] if t else UND for b, t in zip(best.tolist(), (total > 0).tolist(), strict=True)], score


def predict(docs: DataFrame, model: LanguageFilter, size: int = GRAM, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of ``docs`` and the language and score under ``names`` (such columns of ``docs`` are replaced)."""
    languages, n = model.languages, len(model.shards)
    docs = docs.drop(*names)
    common.tune(docs.sparkSession)
    so_far = "_hits"
    while so_far in docs.columns:
        so_far = f"_{so_far}"

    def passed(source: DataFrame, number: int, shard: Shard | None) -> DataFrame:
        held = source.sparkSession.sparkContext.broadcast(shard)
        first, last = number == 0, number >= n - 1

        def run(batches):
            for batch in common.slices(batches):
                text = common.texts(batch)
                found, total = hits(text, held.value, len(languages), number, n, size) if held.value else (np.zeros((len(text), 0)), np.zeros(len(text)))
                rest = batch if first else batch.drop_columns([so_far])
                if not first:
                    found = found + np.frombuffer(b"".join(batch.column(so_far).to_pylist())).reshape(found.shape)
                if last:
                    lang, score = decided(found, total, languages)
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*rest.schema.names, *names])
                else:
                    yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([x.tobytes() for x in found], pa.binary())], names=[*rest.schema.names, so_far])

        out = [StructField(names[0], StringType()), StructField(names[1], DoubleType())] if last else [StructField(so_far, BinaryType())]
        return source.mapInArrow(run, StructType([*docs.schema.fields, *out]))

    found = passed(docs, 0, model.shards[0] if model.shards else None)
    for k in range(1, n):
        # a table between passes, so that a worker holds one shard
        found = passed(common.table(found, "hits"), k, model.shards[k])
    return found
