"""The registered queries themselves: their columns and rows, odd and empty tables, folds, and that nothing leaks."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import queries

from .helpers import ODD, documents, prose, remainder

# The columns that each query must return, at least, and their types.
CONTRACTS = {
    "op1_wavelet_tokens": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2_bagminhash": {"doc_id": "bigint", "class_id": "bigint"},
    "op3_risk_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op4_language_filter": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_license_digests": {"doc_id": "bigint", "digest": "string", "license_id": "string", "notices": "string"},
    "op6_backoff_automaton": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op7_attention_mil": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9_template_decontamination": {"doc_id": "bigint", "contaminated": "boolean", "item_ids": "array<bigint>", "changed_ids": "array<bigint>"},
    "op10_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


def _tables(spark, path, rows, labels, pages=(), items=(), extra=False):
    clash = lambda df, names: df.withColumns({n: F.lit("x") for n in names}) if extra else df
    documents(spark, rows, extra).write.parquet(f"{path}/documents.parquet")
    clash(spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int"), ("q", "agreed", "h", "text")).write.parquet(f"{path}/labels.parquet")
    clash(spark.createDataFrame(list(pages), "page_id long, url string, html string"), ("host", "canon", "n", "maybe")).write.parquet(f"{path}/pages.parquet")
    clash(spark.createDataFrame(list(items), "item_id long, text string"), ("doc_id", "h", "n")).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


LANGUAGES = {"en": "the of and cat dog house".split(), "fr": "éau tre çon les des une".split()}
ROWS = [(k, prose(k, 60, LANGUAGES[lang := ("en", "fr")[k % 2]]), lang) for k in range(40)] + [(100 + k, " ".join(f"{w}###" for w in prose(k, 60, LANGUAGES["en"]).split()), "en") for k in range(20)]
LABELS = [(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(20)]


def test_rows_and_columns_of_every_query(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names: a row for each row."""
    odd = [(i, t, None if k % 2 else "en") for k, (i, t) in enumerate(ODD)] + [(9, "long words " * 60_000, "fr")]
    labels = [*LABELS, (None, 1, 0), (1, None, 0), (0, 1, None), (0, 0, None), (5, 1, 0), (5, 1, 0)]
    pages = [(None, None, None), (1, "", ""), (100, "http://x.org/a", None), (100, "http://x.org/a", ""), (7, "http://x.org/a#b", "x"), (8, "http://y.org/" + "z" * 50_000, None)]
    items = [(None, None), (1, None), (2, ""), (3, "the of and cat dog house of the"), (3, "the of and cat dog house of the")]
    d = _tables(spark, tmp_path, ROWS + odd, labels, pages, items, True)
    ids = collections.Counter(i for i, *_ in ROWS + odd)
    for query in queries.QUERIES:
        df = query(spark, d)
        kinds = dict(df.dtypes)
        assert {c: kinds.get(c) for c in CONTRACTS[query.__name__]} == CONTRACTS[query.__name__], query.__name__
        key = "page_id" if "page_id" in kinds else "doc_id"
        got = df.collect()
        assert collections.Counter(r[key] for r in got) == (collections.Counter(p[0] for p in pages) if key == "page_id" else ids), query.__name__
        for name, fold in (("op4_language_filter", 5), ("op7_attention_mil", 5), ("op6_backoff_automaton", 7)):
            if query.__name__ == name:
                assert all(r["held_out"] == (remainder(r["doc_id"], fold) == (0 if fold == 5 else 2)) for r in got if r["doc_id"] is not None)
        if query.__name__ == "op7_attention_mil":
            assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
        if query.__name__ == "op4_language_filter":
            assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} >= {"und"}
    assert corpus_pipeline.run(spark, d).count() > 0


def test_every_query_on_empty_tables(spark, tmp_path):
    d = _tables(spark, tmp_path, [], [])
    for query in queries.QUERIES:
        assert query(spark, d).count() == 0, query.__name__
    assert corpus_pipeline.run(spark, d).count() == 0


@pytest.mark.parametrize("query", [queries.op4_language_filter, queries.op7_attention_mil])
def test_predictions_ignore_what_they_must_not_see(spark, tmp_path, query):
    """Other languages, labels and sources of held-out rows, and the sources of all, change no prediction."""
    first = _tables(spark, tmp_path / "a", ROWS, LABELS)
    held = lambda i: remainder(i, 5) == 0
    rows = [(i, t, "zz" if held(i) else lang) for i, t, lang in ROWS]
    labels = [(i, 1 - q if held(i) else q, 1) for i, q, _ in LABELS]
    second = _tables(spark, tmp_path / "b", rows, labels)
    spark.read.parquet(f"{second}/documents.parquet").withColumn("source", F.lit("other")).write.parquet(f"{tmp_path}/c/documents.parquet")
    spark.read.parquet(f"{second}/labels.parquet").write.parquet(f"{tmp_path}/c/labels.parquet")
    got = [sorted(map(tuple, query(spark, d).collect())) for d in (first, second, f"{tmp_path}/c")]
    assert got[0] == got[1] == got[2] and any(r[1] for r in got[0])
    # but what is learnt from the other rows counts
    third = _tables(spark, tmp_path / "d", [(i, t, {"en": "fr", "fr": "en"}[lang]) for i, t, lang in ROWS], [(i, 1 - q, 0) for i, q, _ in LABELS])
    assert sorted(map(tuple, query(spark, third).collect())) != got[0]
