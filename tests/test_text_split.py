"""Text expressions, hashes, splits and contexts on small frames."""

import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.functions.stem import stem, stemmed_vocabulary
from sieveline.operators import report, split
from sieveline.sources import io


def _values(spark, column, rows):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string")
    return [r["x"] for r in df.select("k", column.alias("x")).orderBy("k").collect()]


def test_normalize_and_clean(spark):
    assert _values(spark, tx.normalize_text(F.col("t")), ["Ёлка  Москва", None, "  a b　\n", ""]) == ["елка москва", "", "a b", ""]
    assert _values(spark, tx.clean(F.col("t")), [" A  b ", " ", None]) == ["A b", None, None]
    assert _values(spark, tx.space_words(F.col("t")), ["", "a", "a b"]) == [1, 1, 2]


def test_stable_hash_is_the_digest_of_seed_and_value(spark):
    want = [int.from_bytes(hashlib.sha256(f"42\x1f{v}".encode()).digest()[:8], "big") for v in ("a", "ё")]
    assert [int(x) for x in _values(spark, tx.stable_hash(F.col("t"), "42"), ["a", "ё"])] == want
    one = spark.range(1).select(tx.digest_id(F.lit("x"), F.lit(3), F.lit(True)).alias("d"), tx.digest_id(F.lit("x"), F.lit(None)).alias("n")).first()
    assert one["d"] == hashlib.sha256(b"x\x1f3\x1ftrue").hexdigest()[:16] and one["n"] is None


def test_filters(spark):
    text = "Вид услуги Красота, здоровье Тип услуги Маникюр"
    got = _values(spark, tx.parse_filters(F.col("t")), [text, None, "Тип услуги автосервиса Шины Тип услуги А Тип услуги Б"])
    assert got == [{"Вид услуги": "Красота, здоровье", "Тип услуги": "Маникюр"}, {}, {"Тип услуги автосервиса": "Шины", "Тип услуги": "Б"}]
    rows = spark.createDataFrame([(text, "Вид услуги Красота, здоровье"), (text, "Тип услуги Маникюр"), ("", "x"), ("Онлайн-запись", "Онлайн-запись")], "f string, p string")
    match = tx.filter_match(tx.parse_filters(F.col("f")), F.col("p"))
    out = [r.asDict() for r in rows.select(*(c.alias(n) for n, c in match.items())).collect()]
    assert [(r["filt_vid"], r["filt_tip"], r["filt_booking"], r["filt_set"], r["filt_share"]) for r in out] == [(1, 0, None, 2, 0.5), (0, 1, None, 2, 0.5), (None, None, None, 0, None), (None, None, 1, 1, 1)]


def test_markers_scripts_and_masks(spark):
    row = spark.createDataFrame([("Удалённо, Онлайн",)], "t string").select(*tx.marker_columns(F.col("t"))).first().asDict()
    assert row["mk_remote"] == row["mk_online"] == 1 and row["mk_no_trip"] == 0
    assert _values(spark, tx.has_mixed_script(F.col("t")), ["Mосква", "abc где", None]) == [True, False, False]
    got = _values(spark, tx.mask_excerpt(F.col("t"), 30), ["mail a.b@c.de now", "call +7 (999) 123-45-67!", None, "x" * 40])
    assert got == ["mail [email] now", "call [number]!", "", "x" * 30 + "…"]


@pytest.mark.parametrize(("word", "want"), [("холодильников", "холодильник"), ("холодильника", "холодильник"), ("ремонт", "ремонт"), ("важная", "важн"), ("валялся", "валя"), ("красота", "красот"), ("противоестественном", "противоестествен"), ("бегавшая", "бега"), ("важнейшие", "важн"), ("abc", "abc"), ("", "")])
def test_stemmer(word, want):
    assert stem(word) == want


def test_vocabulary_is_stemmed_once(spark):
    words = spark.createDataFrame([("ремонта",), ("ремонта",), (None,)], "word string")
    assert [(r["word"], r["stem"]) for r in stemmed_vocabulary(words).collect()] == [("ремонта", "ремонт")]


def _pairs(spark):
    rows = [("Ёлка  Москва", 1, None, "i1"), ("елка москва", 1, "", "i1"), ("елка москва", 2, "", "i2"), ("баня", 1, None, "i3"), ("баня", 1, "Вид услуги", "i3")]
    raw = spark.createDataFrame(rows, "search_query string, search_location_id long, search_infm_params_text string, item_id string")
    return io.prepare_queries(raw.withColumns({"search_is_delivery_search": F.lit(False), "search_category": F.lit(114).cast("long")}))


def test_contexts_and_samples(spark):
    contexts = split.build_contexts(_pairs(spark), io.CONTEXT_COLS)
    got = {(r["query_text"], r["search_location_id"], r["search_infm_params_text"]): r["item_ids"] for r in contexts.collect()}
    assert len(got) == 4 and got["елка москва", 1, ""] == ["i1"]
    assert all(len(r["query_id"]) == 16 for r in contexts.collect())
    assert split.sample_queries(contexts, 10).count() == 2
    assert split.disjoint(split.assign_parts(contexts))


def test_choice_of_texts_ignores_their_contexts_and_order(spark):
    texts = [f"text {k}" for k in range(60)]
    one = spark.createDataFrame([(t, "0" * 16) for t in texts], "query_text string, query_id string")
    many = spark.createDataFrame([(t, f"{k:016d}") for t in reversed(texts) for k in range(1 + len(t) % 3)], "query_text string, query_id string")
    pick = lambda df: {r["query_text"] for r in split.sample_queries(df, 20).collect()}
    assert pick(one) == pick(many) and len(pick(one)) == 20


def test_shares_of_parts(spark):
    parts = spark.range(4000).select(split.part_of(F.concat(F.lit("t"), "id")).alias("part")).groupBy("part").count().collect()
    share = {r["part"]: r["count"] / 4000 for r in parts}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["dev"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02


def test_repeated_texts(spark):
    contexts = spark.createDataFrame([(t, f"{k:016d}") for k, t in enumerate("aabccdd")], "query_text string, query_id string")
    excluded = spark.createDataFrame([("d",)], "query_text string")
    assert {r["query_text"] for r in split.repeated_text_queries(contexts, excluded, 10).collect()} == {"a", "c"}
    assert split.repeated_text_queries(contexts, excluded, 1).count() == 1


def test_roles(spark):
    queries = spark.createDataFrame([(f"t{k}",) for k in range(200)], "query_text string")
    bucket = queries.where(split.valid_bucket(F.col("query_text")))
    fixed = bucket.orderBy("query_text").limit(3)
    got = split.roles(queries, fixed).groupBy("valid", "excluded").count().collect()
    counts = {(r["valid"], r["excluded"]): r["count"] for r in got}
    assert counts[True, False] == 3 and counts[False, True] == bucket.count() - 3 and (True, True) not in counts


def test_corpus_has_one_row_for_each_item(spark):
    rows = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 1, "y")], "item_id string, v int, w string")
    assert sorted((r["item_id"], r["v"]) for r in split.build_corpus(rows).collect()) == [("a", 1), ("b", 1)]


def test_sources(spark, tmp_path):
    a = spark.createDataFrame([("q1", "i1 i2"), ("q2", "i3")], io.ANSWER_SCHEMA)
    io.write_answer(a, str(tmp_path / "answer"))
    assert io.same_rows(io.read_answer(spark, str(tmp_path / "answer")), a)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        io.write_answer(a, str(tmp_path / "answer"))
    with pytest.raises(ValueError, match="unknown corpus"):
        io.load_corpus(spark, str(tmp_path), "nothing")
    (tmp_path / "f").write_bytes(b"abc")
    io.verify_file(str(tmp_path / "f"), hashlib.sha256(b"abc").hexdigest())
    with pytest.raises(ValueError, match="digest"):
        io.verify_file(str(tmp_path / "f"), "0")
    with pytest.raises(FileNotFoundError):
        io.verify_file(str(tmp_path / "none"), "0")


def test_an_embedding_store_belongs_to_a_corpus_and_a_model(spark, tmp_path):
    texts, calls = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "id long, text string"), []

    def make(df):
        calls.append(1)
        return df.select("id", F.array(F.length("text").cast("float")).alias("embedding"))

    path = str(tmp_path / "e")
    for _ in range(2):
        io.save_embeddings(texts, path, "m1", make, 4)
    assert len(calls) == 4 and io.load_embeddings(spark, path, texts, "m1").count() == 20
    # a run that was cut short goes on with what is missing
    shutil.rmtree(f"{path}/chunk=2")
    with pytest.raises(ValueError, match="incomplete"):
        io.load_embeddings(spark, path, texts, "m1")
    io.save_embeddings(texts, path, "m1", make, 4)
    assert len(calls) == 5 and io.load_embeddings(spark, path, texts, "m1").count() == 20
    changed = texts.withColumn("text", F.concat("text", F.lit("!")))  # the same ids
    for other, tag in ((changed, "m1"), (texts, "m2"), (texts.limit(19), "m1")):
        with pytest.raises(ValueError, match="holds vectors"):
            io.load_embeddings(spark, path, other, tag)
        with pytest.raises(ValueError, match="holds vectors"):
            io.save_embeddings(other, path, tag, make, 4)


def test_caches_know_what_they_were_made_of(spark, tmp_path):
    queries, calls = spark.createDataFrame([("a",), ("b",)], "query_id string"), []

    def make(df):
        def run():
            calls.append(1)
            return df.withColumn("n", F.lit(len(calls)))

        return run

    got = lambda df: sorted(map(tuple, io.cached(spark, str(tmp_path / "c"), df, make(df)).collect()))
    assert got(queries) == got(queries) == [("a", 1), ("b", 1)]
    assert got(queries.limit(1)) == [("a", 2)]  # other queries: not the stale table
    (tmp_path / "c" / "table" / "_SUCCESS").unlink()
    assert got(queries.limit(1)) == [("a", 3)]  # a table that wasn't written whole
    texts, seen = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "text string"), []

    def encoded(df):
        seen.extend(sorted(r["text"] for r in df.collect()))
        return df.select("text", F.array(F.lit(1.0)).alias("embedding"))

    for tag, want in (("m1", ["x", "y"]), ("m1", ["x", "y"]), ("m2", ["x", "y", "x", "y"])):
        assert io.text_vectors(texts, str(tmp_path / "t"), tag, encoded).count() == 2 and seen == want
    io.text_vectors(spark.createDataFrame([("x",), ("z",)], "text string"), str(tmp_path / "t"), "m1", encoded)
    assert seen[4:] == ["z"]


def test_filters_of_any_length(spark):
    """Nothing is cut off, however many entries a filter text has: of a repeated key the last one counts."""
    text = " ".join(f"Вид услуги v{k}" for k in range(12_000))
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(tx.parse_filters(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in got] == [{"Вид услуги": "v11999"}, {}, {}]


def test_reports_and_environment(spark, tmp_path):
    io.write_json(spark, {"é": [1, None]}, str(tmp_path / "x.json"))
    assert io.read_json(spark, str(tmp_path / "x.json")) == {"é": [1, None]}
    versions = {r["name"]: r["version"] for r in io.environment(spark).collect()}
    assert versions["spark"] == spark.version and {"python", "java", "pyarrow"} <= set(versions)
    report.write_html(spark, str(tmp_path / "r.html"), "A <b>", {"rows": spark.range(300).withColumn("x", F.lit(None).cast("string"))}, {"note": "1 & 2"})
    page = (tmp_path / "r.html").read_text()
    assert "A &lt;b&gt;" in page and "1 &amp; 2" in page and page.count("<tr>") == 201 and "first 200 rows" in page
    one, two = (io.digest(df, "id") for df in (spark.range(50), spark.range(50).repartition(7)))
    assert one == two != io.digest(spark.range(51), "id")
