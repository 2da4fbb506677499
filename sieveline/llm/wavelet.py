"""Token-id output: one compressed wavelet-matrix file for each shard of a corpus.

Documents are encoded, an end id is appended to each, and the ids go in ascending doc_id order
into shards. A shard is one Parquet file whose rows are blocks of whole documents; a block
keeps its ids as the bit-planes of a wavelet matrix (most significant bit first) with the number of
zeros of each plane. A plane is cut into chunks of ``CHUNK_BITS`` bits, each compressed by itself, and
the block stores the rank directory: the ones of the plane before each chunk. So access, rank
and select inflate one chunk of each plane that they pass, whatever the size of the block.

Defined results: a null text is an empty one (just the end id); a very long text is one document of
one block; null ids sort first; rows with the same doc_id keep one record each, in order of their
text's hash; an empty table gives no files' rows; only doc_id and text are read, so other columns
may have any name.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm import common

#: Ids after which a block is closed; a longer document still makes one block.
BLOCK_IDS = 1 << 19
#: Bits of a plane that are compressed together, and between two entries of the rank directory.
CHUNK_BITS = 1 << 15

_SCHEMA = "shard int, block int, first_in_shard long, n_ids long, n_docs int, doc_ids binary, id_nulls binary, lengths binary, width int, zeros array<long>, ranks binary, chunks array<binary>"


class Plane:
    """A row of bits with the ones before each of its chunks; chunks are inflated when they are asked for."""

    def __init__(self, ranks: np.ndarray, chunks: list[bytes | np.ndarray]):
        self.ranks, self._chunks = ranks, chunks

    @classmethod
    def build(cls, bits: np.ndarray) -> Plane:
        step = CHUNK_BITS // 8
        chunks = [bits[k : k + step] for k in range(0, len(bits), step)]
        ones = [int(np.bitwise_count(c).sum(dtype=np.int64)) for c in chunks]
        return cls(np.concatenate([[0], np.cumsum(ones, dtype=np.int64)]).astype("<u4"), chunks)

    def chunk(self, c: int) -> np.ndarray:
        held = self._chunks[c]
        if isinstance(held, bytes):
            held = self._chunks[c] = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8)
        return held

    def bits(self) -> np.ndarray:
        return np.concatenate([self.chunk(c) for c in range(len(self._chunks))]) if self._chunks else np.zeros(0, np.uint8)

    def packed(self) -> list[bytes]:
        pack = zstandard.ZstdCompressor(level=1).compress
        return [pack(c.tobytes()) for c in self._chunks]

    def inflated(self) -> int:
        """How many chunks have been inflated."""
        return sum(not isinstance(c, bytes) for c in self._chunks)

    def bit(self, i: int) -> int:
        return int(self.chunk(i // CHUNK_BITS)[i % CHUNK_BITS // 8]) >> (i % 8) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        c, rest = divmod(i, CHUNK_BITS)
        ones = int(self.ranks[c])
        if rest:
            held = self.chunk(c)
            ones += int(np.bitwise_count(held[: rest // 8]).sum(dtype=np.int64))
            ones += (int(held[rest // 8]) & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else 0
        return ones

    def select(self, bit: int, j: int) -> int:
        """Position of the j-th (from 0) bit of the given value."""
        ranks = self.ranks.astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * CHUNK_BITS - ranks
        c = int(np.searchsorted(before, j, "right")) - 1
        bits = np.unpackbits(self.chunk(c), bitorder="little")
        return c * CHUNK_BITS + int(np.flatnonzero(bits == bit)[j - int(before[c])])


class WaveletMatrix:
    """A sequence of ids below 2**width, held as bit-planes with rank and select."""

    def __init__(self, n: int, width: int, zeros: list[int], planes: list[Plane]):
        self.n, self.width, self.zeros, self.planes = n, width, zeros, planes

    @classmethod
    def build(cls, ids: np.ndarray, width: int | None = None) -> WaveletMatrix:
        if width is None:
            width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
        zeros, planes = [], []
        for level in range(width - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << level)).astype(bool)
            planes.append(Plane.build(np.packbits(ones, bitorder="little")))
            high, low = np.compress(ones, ids), np.compress(~ones, ids)  # far faster than masks
            zeros.append(len(low))
            ids = np.concatenate([low, high])
        return cls(len(ids), width, zeros, planes)

    def ids(self) -> np.ndarray:
        """All ids in order: the planes' partitions undone from the last to the first."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k in range(self.width - 1, -1, -1):
            ones = np.unpackbits(self.planes[k].bits(), count=self.n, bitorder="little").view(bool)
            z, up = self.zeros[k], np.empty(self.n, kind)
            up[np.flatnonzero(~ones)] = out[:z]
            up[np.flatnonzero(ones)] = out[z:] | kind(1 << (self.width - 1 - k))
            out = up
        return out.astype(np.uint32)

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for zeros, plane in zip(self.zeros, self.planes, strict=True):
            ones, bit = plane.rank1(i), plane.bit(i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        for k, plane in enumerate(self.planes):
            a, b = plane.rank1(start), plane.rank1(stop)
            start, stop = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.width - 1 - k) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id occurs among positions start to stop."""
        if value >> self.width:
            return 0
        a, b = self._range(value, start, self.n if stop is None else stop)
        return b - a

    def select(self, value: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of an id."""
        if not 0 <= j < self.count(value):
            raise IndexError(f"id {value} has no occurrence {j}")
        i = self._range(value, 0, self.n)[0] + j
        for k in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - k) & 1
            i = self.planes[k].select(bit, i - self.zeros[k] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, j) for j in range(self.count(value))]


class CachedEncoder:
    """Byte-level BPE over distinct pieces of text, each encoded once by the tokenizers library.

    The vocabulary's pre-tokenizer never joins a character that isn't white space to white space
    after it, so a text can be cut before each single space. Runs of white space that hold a
    space between two others, and texts with special tokens, are encoded whole. New pieces are
    encoded many in a row; as each holds one space, its first character, the ids whose strings
    begin with a space tell where each piece begins.
    """

    SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    #: Pieces remembered between batches, and pieces encoded in a row.
    KEEP, ROW = 400_000, 2000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[0] == "\u0120"]] = True
        self.known = pa.array([], pa.string())
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, np.uint32) for k in range(0, len(pieces), 16) for e in run(pieces[k : k + 16], add_special_tokens=False)]

    def _encode_distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in order, and how many each has."""
        odd = pc.or_(pc.invert(pc.starts_with(pieces, " ")), pc.match_substring_regex(pieces, f"^ {self.SPACE}|{self.SPACE}$")).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(pieces), np.int64)
        # the texts of a filtered array follow each other in one buffer
        plain = pieces.filter(pa.array(~odd))
        _, ends, data = plain.buffers()
        cuts = np.frombuffer(ends, np.int32)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int32)
        cuts = np.append(cuts[: len(plain) : self.ROW], cuts[-1]).tolist()
        rows = self._encode([str(data[a:b].to_pybytes(), "utf-8") for a, b in itertools.pairwise(cuts)])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
        counts[~odd] = np.diff(np.append(np.flatnonzero(self.begins[flat]), len(flat)))
        if not odd.any():
            return flat, counts
        alone = self._encode(pieces.filter(pa.array(odd)).to_pylist())
        counts[odd] = [len(x) for x in alone]
        ids, at = np.empty(counts.sum(), np.uint32), np.repeat(odd, counts)
        ids[~at] = flat
        ids[at] = np.concatenate(alone) if alone else flat[:0]
        return ids, counts

    def _whole(self, text: pa.Array) -> np.ndarray:
        """Which texts can't be cut at their spaces."""
        mask = pc.match_substring_regex(text, f"(^|{self.SPACE}) ({self.SPACE}|$)")
        for s in self.special:
            mask = pc.or_(mask, pc.match_substring(text, s))
        return mask.to_numpy(zero_copy_only=False).astype(bool)

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each has."""
        whole = self._whole(text)
        cut = pc.if_else(pa.array(whole), "", text)
        lists = pc.split_pattern(cut, " ")
        flat, n_pieces = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        # a first piece has no space before it; the others get theirs back
        codes, distinct = common.coded(flat)
        size = len(distinct)
        first = np.zeros(len(flat), bool)
        first[np.cumsum(n_pieces) - n_pieces] = True
        heads, codes = np.unique(codes[first]), np.where(first, codes + size, codes)
        remap = np.zeros(2 * size, np.int64)
        remap[:size] = np.arange(size)
        remap[heads + size] = size + np.arange(len(heads))
        codes = remap.take(codes)
        pieces = pa.concat_arrays([pc.binary_join_element_wise("", distinct, " "), distinct.take(pa.array(heads))])
        found = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = found < 0
        fresh = pieces.filter(pa.array(new))
        ids, counts = self._encode_distinct(fresh)
        starts, lengths = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        starts[~new], lengths[~new] = self.starts[found[~new]], self.lengths[found[~new]]
        starts[new], lengths[new] = len(self.pool) + np.cumsum(counts) - counts, counts
        pool = np.concatenate([self.pool, ids])
        if (room := self.KEEP - len(self.known)) > 0:
            kept = fresh[:room]
            self.known = pa.concat_arrays([self.known, kept])
            n = int(counts[: len(kept)].sum())
            self.starts = np.concatenate([self.starts, len(self.pool) + (np.cumsum(counts) - counts)[: len(kept)]])
            self.lengths = np.concatenate([self.lengths, counts[: len(kept)]])
            self.pool = pool[: len(self.pool) + n].copy()
        each = lengths.take(codes)
        ends = np.cumsum(each)
        kind = np.int32 if len(pool) + (ends[-1] if len(ends) else 0) < 1 << 31 else np.int64
        at = np.repeat((starts.take(codes) - (ends - each)).astype(kind), each)
        at += np.arange(len(at), dtype=kind)
        ids, counts = pool.take(at), common.segment_sums(each, n_pieces)
        if whole.any():
            full = self._encode(text.filter(pa.array(whole)).to_pylist())
            # a text encoded whole stands for an empty one, which has no ids
            parts, last, ends = [], 0, np.cumsum(counts)
            for row, e in zip(np.flatnonzero(whole), full, strict=True):
                parts += [ids[last : ends[row]], e]
                last = ends[row]
                counts[row] = len(e)
            ids = np.concatenate([*parts, ids[last:]])
        return ids, counts


_encoders: dict[str, CachedEncoder] = {}


def _encoder(path: str) -> CachedEncoder:
    """The worker's encoder, with what it remembers from earlier tasks."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard, block, first = TaskContext.get().partitionId(), 0, 0
    encode, pack = _encoder(path), zstandard.ZstdCompressor(level=1).compress
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        nonlocal block, first
        doc_ids, nulls, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        m = WaveletMatrix.build(ids)
        row = {
            "shard": shard, "block": block, "first_in_shard": first, "n_ids": len(ids), "n_docs": len(counts),
            "doc_ids": pack(doc_ids.tobytes()), "id_nulls": pack(np.packbits(nulls).tobytes()), "lengths": pack(counts.astype("<i8").tobytes()),
            "width": m.width, "zeros": m.zeros, "ranks": np.concatenate([p.ranks for p in m.planes]).tobytes(), "chunks": [c for p in m.planes for c in p.packed()],
        }
        block, first = block + 1, first + len(ids)
        return pa.RecordBatch.from_pylist([row], schema=_ARROW)

    for batch in common.slices(batches):
        ids, counts = _with_end(*encode(common.texts(batch)), end_id)
        doc_id = batch.column("doc_id")
        held.append((pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False).astype("<i8"), doc_id.is_null().to_numpy(zero_copy_only=False), counts, ids))
        if sum(len(x[3]) for x in held) >= block_ids:
            yield flush()
    if held:
        yield flush()


_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first_in_shard", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32())]
    + [("doc_ids", pa.binary()), ("id_nulls", pa.binary()), ("lengths", pa.binary()), ("width", pa.int32()), ("zeros", pa.list_(pa.int64())), ("ranks", pa.binary()), ("chunks", pa.list_(pa.binary()))]
)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write one wavelet-matrix file for each range of ids."""
    common.tune(docs.sparkSession)
    # many rows with one id, or without one, are dealt on by the hash of their text
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(lambda it: _blocks(it, tokenizer, end_id, block_ids), _SCHEMA).write.option("compression", "none").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all files, each with ``start``: the number of ids in all blocks before it."""
    blocks = spark.read.schema(_SCHEMA).parquet(path)
    # one row for each shard, never one for each document
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    # as many rows as the files have partitions, and two numbers in each
    return blocks.join(F.broadcast(starts), "shard").withColumn("start", F.col("shard_start") + F.col("first_in_shard"))


def open_block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """doc_ids, which of them are null, ids of each document, and the matrix of a block's row."""
    unpack = zstandard.ZstdDecompressor().decompress
    n = row["n_docs"]
    nulls = np.unpackbits(np.frombuffer(unpack(row["id_nulls"]), np.uint8), count=n).astype(bool)
    ranks, each = np.frombuffer(row["ranks"], "<u4").reshape(row["width"], -1), len(row["chunks"]) // row["width"]
    planes = [Plane(ranks[k], list(row["chunks"][k * each : (k + 1) * each])) for k in range(row["width"])]
    matrix = WaveletMatrix(row["n_ids"], row["width"], list(row["zeros"]), planes)
    return np.frombuffer(unpack(row["doc_ids"]), "<i8"), nulls, np.frombuffer(unpack(row["lengths"]), "<i8"), matrix


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            doc_ids, nulls, lengths, matrix = open_block(row)
            data, ends = memoryview(matrix.ids().astype("<u4").tobytes()), np.cumsum(lengths)
            crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=nulls), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    common.tune(spark)
    return read_blocks(spark, path).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """How often an id occurs in each shard, from rank queries alone."""

    def counts(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{"shard": r["shard"], "n": open_block(r)[3].count(token)} for r in rows], schema=pa.schema([("shard", pa.int32()), ("n", pa.int64())]))

    return spark.read.schema(_SCHEMA).parquet(path).mapInArrow(counts, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id and position (in the document, from 0) of every occurrence of an id, from select queries alone."""

    def places(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, nulls, lengths, matrix = open_block(batch.slice(i, 1).to_pylist()[0])
                at = np.array(matrix.occurrences(token), np.int64)
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[doc], mask=nulls[doc]), pa.array(at - (ends - lengths)[doc])], names=["doc_id", "position"])

    return spark.read.schema(_SCHEMA).parquet(path).mapInArrow(places, "doc_id long, position long")
