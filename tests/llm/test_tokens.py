"""Token files and BPE: exact against the tokenizers library, and the wavelet matrix against arrays."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sieveline.llm import bpe, common, wavelet

from .helpers import ODD, documents, prose

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def _ids(path, text):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t.encode(text or "", add_special_tokens=False).ids


def _noise(n, seed=1):
    parts = [" ", "  ", "\n", "a", "b", "'s", "1", "!", "\t", " ", "é", "　", "<|endoftext|>", "\x0b", "\x1f", "\x85", "Ġ", "İ", "Σ", "hello", "漢", "🎉", "é"]
    r = random.Random(seed)
    return ["".join(r.choices(parts, k=r.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 600, 3000])
def test_wavelet_matrix_is_the_sequence(n):
    r = np.random.default_rng(n)
    ids = r.integers(0, 70000 if n == 3000 else 50, n)
    m = wavelet.WaveletMatrix.build(ids)
    assert m.ids().tolist() == ids.tolist()
    for i in r.integers(0, n, 20 if n else 0).tolist():
        v = int(ids[i])
        where = np.flatnonzero(ids == v).tolist()
        assert m.access(i) == v
        assert m.occurrences(v) == where
        assert m.count(v, i, n) == sum(w >= i for w in where)
    assert m.count(1 << 20) == 0


def test_access_from_a_file_inflates_a_chunk_of_each_plane(spark):
    """A block of many chunks: each question reads one chunk of a plane, and the answers are the array's."""
    r = np.random.default_rng(5)
    docs = documents(spark, [(k, " ".join(r.choice(["alpha", "beta", "gamma", "9", "!"], 30_000))) for k in range(3)])
    path = common.shared_path(spark, "test-chunks")
    wavelet.write_tokens(docs.coalesce(1), path, BYTE)
    row = max(spark.read.schema(wavelet._SCHEMA).parquet(path).collect(), key=lambda x: x["n_ids"])
    ids = wavelet.open_block(row)[3].ids()
    assert len(row["chunks"]) == row["width"] * -(-len(ids) // wavelet.CHUNK_BITS) > 2 * row["width"]
    for i in (0, 7, len(ids) // 2, len(ids) - 1):
        m = wavelet.open_block(row)[3]
        assert m.access(i) == ids[i] and all(p.inflated() <= 1 for p in m.planes)
    m, v = wavelet.open_block(row)[3], int(ids[11])
    assert m.count(v) == (ids == v).sum() and m.select(v, 1000) == np.flatnonzero(ids == v)[1000]
    assert sum(p.inflated() for p in m.planes) <= 5 * row["width"]


def test_cached_encoder_equals_the_library():
    texts = _noise(3000)
    encode = wavelet.CachedEncoder(BYTE)
    whole = Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)
    for part in (slice(0, 2000), slice(2000, 3000)):
        ids, counts = encode(pa.array(texts[part]))
        ends = np.cumsum(counts)
        for e, n, x in zip(ends, counts, whole[part], strict=True):
            assert ids[e - n : e].tolist() == x.ids


def test_own_bpe_equals_the_library():
    texts = _noise(2000, 2)
    mine, library = bpe.BPE(WORD), Tokenizer.from_file(WORD)
    library.no_truncation()
    library.no_padding()
    for text, x in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.encode(text) == x.ids
        assert mine.decode(x.ids) == library.decode(x.ids, skip_special_tokens=False)


@pytest.mark.parametrize("extra", [False, True])
def test_token_files(spark, extra):
    rows = [*ODD, *((100 + i, prose(i, 50 * i)) for i in range(12))]
    docs = documents(spark, rows, extra)
    path = common.shared_path(spark, "test-tokens")
    wavelet.write_tokens(docs, path, BYTE, block_ids=700)
    got = sorted(wavelet.read_digests(spark, path).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"]) for r in got] == sorted((i is not None, i) for i, _ in rows)
    by_id, start = dict(rows), 0
    for r in got:
        ids = [*_ids(BYTE, by_id[r["doc_id"]]), 0]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    ends = sum(_ids(BYTE, t).count(0) + 1 for _, t in rows)
    assert sum(r["n"] for r in wavelet.count_token(spark, path, 0).collect()) == ends
    token = _ids(BYTE, "long")[0]
    found = sorted(((r["doc_id"], r["position"]) for r in wavelet.find_token(spark, path, token).collect()), key=str)
    assert found == sorted(((i, k) for i, t in rows for k, x in enumerate(_ids(BYTE, t)) if x == token), key=str)


def test_token_files_of_an_empty_table(spark):
    path = common.shared_path(spark, "test-empty")
    wavelet.write_tokens(documents(spark, []), path, BYTE)
    assert wavelet.read_digests(spark, path).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_bpe_digests(spark, extra):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(_noise(50, 3)))]
    library = Tokenizer.from_file(WORD)
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digests(documents(spark, rows, extra), WORD).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = _ids(WORD, t)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.encode_digests(documents(spark, []), WORD).count() == 0


def test_bpe_documents(spark):
    got = {r["doc_id"]: r for r in bpe.encode_documents(documents(spark, [(1, "Hello there"), (2, None)]), WORD).collect()}
    assert got[1]["ids"] == _ids(WORD, "Hello there") and got[2]["ids"] == []
    assert got[1]["decoded"] == "hello</w> there</w>"
