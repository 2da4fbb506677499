"""BPE encoding and decoding with a priority queue of merge ranks over a linked symbol list.

Each distinct word is encoded once: its symbols form a doubly linked list, every adjacent pair
that the vocabulary can merge enters a heap by (rank, position), and an entry whose pair has
changed since is skipped when it comes up. Ids are decoded by looking their strings up and
concatenating them as the vocabulary's library does: joined by one space where the tokenizer
has no decoder of its own.

Defined results: a null or blank text has no ids, so the digests are those of the empty string; a
very long text is encoded whole; rows with the same doc_id are kept apart; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import common

#: Words that a worker remembers between batches, in each of two generations.
KEEP = 250_000


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class BPE:
    """A lower-casing byte-level BPE with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        pieces = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pieces["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        symbols = byte_symbols()
        self.first = [self.vocab[symbols[b]] for b in range(256)]
        self.last = [self.vocab[symbols[b] + self.suffix] for b in range(256)]
        #: (left id, right id) packed in one number -> rank and id of the merged symbol
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a] << 20 | self.vocab[b]] = (rank, self.vocab[a + b])
        self.known: dict[str, tuple[int, ...]] = {}

    def normal(self, text: str) -> str:
        """Composed form, then each character lower-cased on its own."""
        if text.isascii():
            return text.lower()
        import unicodedata

        return "".join(map(str.lower, unicodedata.normalize("NFC", text)))

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        raw = piece.encode()
        ids = [self.first[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        n = len(ids)
        if n == 1:
            return ids
        merges, after, before = self.merges, list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, heap = [-1] * n, []
        for i in range(n - 1):
            if found := merges.get(ids[i] << 20 | ids[i + 1]):
                ranks[i] = found[0]
                heap.append((found[0], i))
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            if ranks[i] != rank:
                continue  # stale: this pair has changed or gone
            j = after[i]
            ids[i] = merges[ids[i] << 20 | ids[j]][1]
            ids[j] = ranks[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get(ids[i] << 20 | ids[k]):
                    ranks[i] = found[0]
                    heappush(heap, (found[0], i))
                else:
                    ranks[i] = -1
            else:
                ranks[i] = -1
            if (h := before[i]) >= 0:
                if found := merges.get(ids[h] << 20 | ids[i]):
                    ranks[h] = found[0]
                    heappush(heap, (found[0], h))
                else:
                    ranks[h] = -1
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special tokens included, without any added around it."""
        out: list[int] = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append(self.special[part])
                continue
            for piece in self.find(self.normal(part)):
                ids = self.known.get(piece)
                if ids is None:
                    ids = tuple(self.merge(piece))
                    if len(piece) < 40:
                        if len(self.known) >= KEEP:
                            self.known.clear()
                        self.known[piece] = ids
                out += ids
        return out

    def decode(self, ids) -> str:
        """The strings of the ids, joined as the library joins them."""
        return " ".join(map(self.strings.__getitem__, ids))


class WordCache:
    """Remembers the words of recent batches; a full generation ages and the older one goes."""

    def __init__(self):
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def get(self, word: str):
        found = self.young.get(word)
        if found is None and (found := self.old.get(word)) is not None:
            self.put(word, found)
        return found

    def put(self, word: str, value: tuple[int, str, str]) -> None:
        if len(word) > 40:
            return
        if len(self.young) >= KEEP:
            self.old, self.young = self.young, {}
        self.young[word] = value


def _joined(parts: pa.Array, counts: np.ndarray) -> pa.Array:
    """One string for each row: its parts with a space between, empty parts left out."""
    keep = pc.greater(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)
    run = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum(counts)
    offsets = np.concatenate([[0], run[ends]])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), parts.filter(pa.array(keep)).cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def encoded(text: pa.Array, bpe: BPE, cache: WordCache) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """For each text the number of ids, the ids as decimals joined by a space, and the decoded text."""
    flat, counts = common.words(text)
    codes, distinct = common.coded(flat)
    ns, ids, strings = [], [], []
    for word in distinct.to_pylist():
        found = cache.get(word)
        if found is None:
            got = bpe.encode(word)
            found = (len(got), " ".join(map(str, got)), bpe.decode(got))
            cache.put(word, found)
        ns.append(found[0])
        ids.append(found[1])
        strings.append(found[2])
    n = common.segment_sums(np.array(ns, np.int64)[codes] if ns else np.zeros(0, np.int64), counts)
    take = pa.array(codes)
    return n, _joined(pa.array(ids, pa.large_string()).take(take), counts), _joined(pa.array(strings, pa.large_string()).take(take), counts)


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe, cache = BPE(path), WordCache()

    def sha(column: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(x).hexdigest() for x in column.cast(pa.large_binary()).to_pylist()], pa.string())

    for batch in common.slices(batches):
        n, ids, strings = encoded(common.texts(batch), bpe, cache)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), sha(ids), sha(strings)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    common.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _digests(it, tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of every document."""

    def run(batches):
        bpe = BPE(tokenizer)
        for batch in common.slices(batches):
            ids = [bpe.encode(t) for t in common.texts(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    common.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
