"""Scans and sinks: Parquet, answer CSV, JSON, embedding stores, caches, models and checksums."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import normalize_text

# The columns that identify a query, and those of an item.
CONTEXT_COLS = ["query_text", "search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category"]
ITEM_COLS = [
    "item_id", "item_title_raw", "item_description_raw", "item_infm_params_text", "item_category_id", "item_microcat_id", "item_price",
    "item_rating", "item_rating_reviews_count", "item_location_id", "item_latitude", "item_longitude", "item_is_phone_hidden", "item_is_message_forbidden",
]
CORPORA = {"split": "split_items.parquet", "benchmark": "benchmark_items.parquet"}
ANSWER_SCHEMA = "query_id string, answer string"


_own: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; without one, a temporary folder on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="sieveline-"))
        named = f"file://{_own[0]}"
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def prepare_queries(df: DataFrame) -> DataFrame:
    """Adds the normalised query text; null filters become empty."""
    return df.withColumns({"query_text": normalize_text(F.col("search_query")), "search_infm_params_text": F.coalesce("search_infm_params_text", F.lit(""))})


def load_train(spark: SparkSession, path: str) -> DataFrame:
    return prepare_queries(spark.read.parquet(path))


def load_corpus(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The item columns of a named corpus; keys are ids, so no order is imposed."""
    if name not in CORPORA:
        raise ValueError(f"unknown corpus {name!r}; one of {sorted(CORPORA)}")
    return spark.read.parquet(f"{root}/{CORPORA[name]}").select(ITEM_COLS)


def load_eval(spark: SparkSession, root: str, part: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, evaluation queries of a part, and the items seen in training contexts."""
    seen = spark.read.parquet(f"{root}/contexts_train.parquet").select(F.explode("item_ids").alias("item_id")).distinct()
    return load_corpus(spark, root, "split"), spark.read.parquet(f"{root}/eval_{part}.parquet"), seen


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_answer(answer: DataFrame, path: str) -> None:
    """One CSV file with a header; an existing path is refused."""
    answer.select("query_id", "answer").coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER_SCHEMA).option("header", True).csv(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """Write to any file system that Spark knows, over what is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def digest(df: DataFrame, *columns: str) -> str:
    """A key of a table's rows, whatever their order: their number and two sums of hashes of ``columns``."""
    h = [F.xxhash64(F.lit(seed), *columns) for seed in (0, 1)]
    r = df.agg(F.count("*"), F.bit_xor(h[0]), F.coalesce(F.sum(F.pmod(h[1], F.lit(2**31 - 1))), F.lit(0))).first()
    return f"{r[0]}-{(r[1] or 0) & (2**64 - 1):016x}-{r[2]:x}"


def save_embeddings(texts: DataFrame, path: str, tag: str, encode: Callable[[DataFrame], DataFrame], chunks: int = 16) -> None:
    """Vectors of ``texts`` (id, text) by chunk of the id's hash, for one corpus and one model (``tag``).

    A run that was cut short goes on with the chunks that aren't there; ``store.json`` says what the
    store holds, and a store of another corpus or model is refused.
    """
    spark, key = texts.sparkSession, {"corpus": digest(texts, "id", "text"), "model": tag, "chunks": chunks}
    if exists(spark, f"{path}/store.json"):
        if (held := read_json(spark, f"{path}/store.json")) != key:
            raise ValueError(f"{path} holds vectors of {held}, not of {key}")
    else:
        write_json(spark, key, f"{path}/store.json")
    for chunk in range(chunks):
        if not exists(spark, f"{path}/chunk={chunk}/_SUCCESS"):
            own = texts.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk)
            encode(own).write.mode("overwrite").parquet(f"{path}/chunk={chunk}")


def load_embeddings(spark: SparkSession, path: str, texts: DataFrame, tag: str) -> DataFrame:
    """id and embedding of all ``texts`` (id, text); raises if the store is of another corpus or model, or incomplete."""
    held = read_json(spark, f"{path}/store.json")
    key = {"corpus": digest(texts, "id", "text"), "model": tag}
    if {k: held[k] for k in key} != key:
        raise ValueError(f"{path} holds vectors of {held}, not of {key}")
    if not all(exists(spark, f"{path}/chunk={k}/_SUCCESS") for k in range(held["chunks"])):
        raise ValueError(f"{path} is incomplete")
    return spark.read.option("basePath", path).parquet(*(f"{path}/chunk={k}" for k in range(held["chunks"]))).drop("chunk")


def text_vectors(texts: DataFrame, path: str, tag: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """text and embedding of each distinct text: from the model's cache at ``path`` or, if not there, encoded and added."""
    spark, own = texts.sparkSession, f"{path}/{tag}"
    wanted = texts.select("text").where("text is not null").distinct()
    known = spark.read.parquet(own) if exists(spark, own) else None
    new = wanted.join(known.select("text"), "text", "left_anti") if known is not None else wanted
    if not new.isEmpty():
        encode(new).select("text", "embedding").write.mode("append").parquet(own)
    return wanted.join(spark.read.parquet(own), "text")


def cached(spark: SparkSession, path: str, queries: DataFrame, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was written whole for the same ``queries`` (query_id), else computed and written anew."""
    key = digest(queries, "query_id")
    whole = exists(spark, f"{path}/table/_SUCCESS") and exists(spark, f"{path}/key.json")
    if not whole or read_json(spark, f"{path}/key.json") != key:
        compute().write.mode("overwrite").parquet(f"{path}/table")
        write_json(spark, key, f"{path}/key.json")
    return spark.read.parquet(f"{path}/table")


def save_model(spark: SparkSession, model, contract: dict, path: str) -> None:
    """A fitted pipeline and, beside it, the contract that it was trained under; an existing path is refused."""
    if exists(spark, path):
        raise ValueError(f"{path} exists")
    model.save(f"{path}/model")
    write_json(spark, contract, f"{path}/contract.json")


def load_model(spark: SparkSession, path: str) -> tuple[object, dict]:
    """The fitted pipeline and its contract."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), read_json(spark, f"{path}/contract.json")


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verify_file(path: str, expected: str) -> None:
    """A missing file and a wrong digest are different errors."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    if (found := sha256_file(path)) != expected:
        raise ValueError(f"{path}: digest {found}, expected {expected}")


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, rows and digest of each table, whatever its files: read in parallel, never a whole file at once."""
    rows = []
    for path in paths:
        df = spark.read.parquet(path)
        rows.append((path.rpartition("/")[2], *(digest(df, *df.columns).split("-", 1))))
    return spark.createDataFrame(rows, "name string, n_rows string, digest string").withColumn("n_rows", F.col("n_rows").cast("long"))


def environment(spark: SparkSession) -> DataFrame:
    """name and version of what a result depends on."""
    from importlib.metadata import PackageNotFoundError, version
    from platform import python_version

    rows = [("python", python_version()), ("spark", spark.version), ("java", spark._jvm.System.getProperty("java.version"))]
    for name in ("numpy", "pandas", "pyarrow"):
        try:
            rows.append((name, version(name)))
        except PackageNotFoundError:
            rows.append((name, None))
    return spark.createDataFrame(rows, "name string, version string")
