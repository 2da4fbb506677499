"""What the corpus operators share: Arrow text helpers, shared storage, folds."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at once, but for single longer rows.
SLICE_BYTES = 8 << 20
#: Bytes at which Spark closes an Arrow batch, whatever the number of its rows.
BATCH_BYTES = 16 << 20

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only on a local master is a temporary one made where ``spark.checkpoint.dir`` is unset; on a
    cluster, executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="sieveline-"))
    return f"file://{_own_dir[0]}"


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for tables that hold very long documents."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`table` that nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: A join sets a key apart from this many rows on, or from a ``HOT_KEYS``-th of all rows if that is more.
HOT_ROWS, HOT_KEYS = 64, 4096


def hot_limit(total: int) -> int:
    """Rows that a key may have before it is hot; at most ``HOT_KEYS`` keys of ``total`` rows have more."""
    return max(HOT_ROWS, total // HOT_KEYS)


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has each key once and, as ``n``, at least its number of rows in ``left``.

    Hot keys, at most ``HOT_KEYS`` rows of ``right``, are broadcast, so their rows stay where they
    are; the others are shuffled. ``total`` is the sum of ``n``. Where keys are hot ``left`` is read twice.
    """
    hot = right.where(F.col("n") > hot_limit(total)).withColumn("_k", F.xxhash64(*on)).collect()
    if not hot:
        return left.join(right, on, how)
    near = right.sparkSession.createDataFrame([tuple(r)[:-1] for r in hot], right.schema)
    known = F.xxhash64(*on).isin([r["_k"] for r in hot])
    return left.where(known).join(F.broadcast(near), on, how).unionByName(left.where(~known).join(right.where(~known), on, how))


def free_shuffles(spark: SparkSession, rounds: int = 4, wait: float = 1.0) -> None:
    """Let Spark delete the shuffle files of finished plans now, not whenever the driver's heap is next collected.

    Python's references go first, beside the driver, then what they held there, then the executors' files;
    ``wait`` gives each step its time before more files are written.
    """
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows whose texts hold at most ``limit`` bytes together.

    Memory that the runs needed goes back to the system after the last one.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


_trim: list = []


def release() -> None:
    """Give memory that a worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if not _trim:
        import ctypes

        _trim.append(getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None))
    _trim[0](0)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column without nulls."""
    return pc.fill_null(batch.column(column), "")


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all rows in order, and how many each row has."""
    if not len(text):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(keep, min_count=0).as_py():
        mask = keep.to_numpy(zero_copy_only=False)
        run = np.concatenate([[0], np.cumsum(mask)])
        ends = np.cumsum(counts)
        counts = run[ends] - run[ends - counts]
        flat = flat.filter(keep)
    return flat, counts


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the distinct words they point to."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts[i]`` rows of ``values``; 0 for an empty run."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=out.dtype)
    return out


def owners(counts: np.ndarray) -> np.ndarray:
    """For each element the row it belongs to."""
    return np.repeat(np.arange(len(counts)), counts)


_M = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _M(30)
    x *= _M(0xBF58476D1CE4E5B9)
    x ^= x >> _M(27)
    x *= _M(0x94D049BB133111EB)
    x ^= x >> _M(31)
    return x


def string_hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string; equal strings hash alike on every executor."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v, seed) for v in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def held_out(doc_id: Column, n: int, r: int) -> Column:
    """Whether a row is held out; a row without id is never learnt from."""
    return F.coalesce(remainder(doc_id, n) == r, F.lit(True))
