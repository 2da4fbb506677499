"""Quality rules whose cutoffs have a proven limit on false rejection.

Each rule rejects a document whose measured share exceeds a cutoff from a fixed grid. For each
stratum (a language) and rule, the labelled documents of quality 1 that pass the base rules are
a holdout: of n such documents x exceed a cutoff. A cutoff is certified where at most x of n would
exceed it with probability ``level`` or less if the true rate were the allowed one, which is where
the exact (Clopper-Pearson) upper bound of the rate is within it. Cutoffs are tested from the
mildest to the strictest and the last before the first failure is taken; such a fixed sequence
needs no correction within itself. Over rules and strata the error level is divided by their
number (Bonferroni), so that with probability 1 - ``delta`` no stratum loses more than ``risk`` of
its good documents, each rule having an equal share of it. A rule without such a cutoff is off.

The bound needs independent documents: a text that several labelled documents of a stratum hold
counts once, and so does a document with several label rows, which is good where all of them say
so. Near copies in a holdout are not looked for.

Strata are counted, tested and joined as tables; a language that many documents share is joined
where its rows are, and nothing grows on the driver with the number of languages.

Defined results: a null text has no words and fails the base rules; a very long text is measured
whole; a document without label or with a null language is judged like any other (null is a
stratum of its own); rows with the same doc_id are kept apart; an empty table gives an empty
result; of documents doc_id, text and lang, of labels doc_id and quality are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import common

RISK = 0.05
DELTA = 0.05
#: Rules: a name and the share it measures.
RULES: dict[str, str] = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_upper / greatest(n_letters, 1)",
}
GRID = [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0]

_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]


def repeated_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row the words inside 3-word windows that the row holds twice or more."""
    n = np.maximum(counts - 2, 0)
    row = common.owners(n)
    start = (np.cumsum(counts) - counts)[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    key = common.mix(row.astype(np.uint64) + np.uint64(1))
    for k in range(3):
        key = common.mix(key + codes[start + k].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    same = key[order][1:] == key[order][:-1]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[start[again] + k] = True
    return common.segment_sums(covered.astype(np.int64), counts)


def duplicate_lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the lines with a word, and how many of them equal an earlier one."""
    lists = pc.split_pattern(text, "\n")
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)
    codes, distinct = common.coded(flat)
    row = common.owners(counts)[worded]
    pairs = np.unique(row * len(distinct) + codes[worded])
    lines = np.bincount(row, minlength=len(text))
    return lines, lines - np.bincount(pairs // max(len(distinct), 1), minlength=len(text))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        text = common.texts(batch)
        flat, counts = common.words(text)
        codes, distinct = common.coded(flat)
        chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        upper = pc.count_substring_regex(distinct, r"\p{Lu}").to_numpy(zero_copy_only=False).astype(np.int64)
        letter = pc.count_substring_regex(distinct, r"\p{L}").to_numpy(zero_copy_only=False).astype(np.int64)
        symbols = pc.count_substring_regex(distinct, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
        lines, dups = duplicate_lines(text)
        sums = common.segment_sums(np.stack([chars, symbols, upper, letter], axis=1)[codes], counts)
        found = [counts, sums[:, 0], sums[:, 1], dups, repeated_words(codes, counts), lines, sums[:, 2], sums[:, 3]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("stratum"), batch.column("h"), *(pa.array(np.asarray(x, np.int64)) for x in found)], names=["doc_id", "stratum", "h", *_COLUMNS])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, h (the text's hash), the measures and base_failed of every document."""
    common.tune(docs.sparkSession)
    # a null language has a key of its own
    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("stratum")
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long"), text.alias("text"), stratum, F.xxhash64(text).alias("h"))
    out = source.mapInArrow(_measured, "doc_id long, stratum string, h long, " + ", ".join(f"{c} long" for c in _COLUMNS))
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out, m = d, 0
    while True:
        m += 1
        step = 0.0
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            step = d * c
            out *= step
        if abs(step - 1) < 1e-15:
            return out


def at_most(x: int, n: int, p: float) -> float:
    """The probability that at most x of n independent events of rate p happen."""
    if x >= n or p <= 0:
        return 1.0
    if x < 0 or p >= 1:
        return 0.0
    # the regularised incomplete beta function of 1 - p with n - x and x + 1
    a, b, y = n - x, x + 1, 1 - p
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log1p(-p) + b * log(p))
    return front * _fraction(a, b, y) / a if y < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, p) / b


def upper_bound(x: int, n: int, level: float) -> float:
    """The rate p at which at most x of n events has probability ``level``: the exact upper bound."""
    if x >= n:
        return 1.0
    low, high = x / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(x, n, mid) > level else (low, mid)
    return high


def certified(n: int, over: list[int], share: float, level: float) -> int | None:
    """The place of the strictest certified cutoff in an ascending grid, ``over`` being how many of n exceed each."""
    chosen = None
    for k in reversed(range(len(over))):
        # the same as upper_bound(over[k], n, level) <= share
        if at_most(over[k], n, share) > level:
            break
        chosen = k
    return chosen


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """For each stratum with a holdout the certified cutoff of each rule (cut_*), null where there is none."""
    good = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1 and doc_id is not null").select("doc_id")
    holdout = found.where("not base_failed").join(good, "doc_id").groupBy("stratum", "h").agg(*(F.first(c).alias(c) for c in _COLUMNS))
    sums = [F.sum(F.expr(f"cast({rule} > {t} as long)")).alias(f"{name}_{k}") for name, rule in RULES.items() for k, t in enumerate(GRID)]
    strata = common.table(holdout.groupBy("stratum").agg(F.count("*").alias("size"), *sums), "strata")
    level, share = delta / max(1, len(RULES) * strata.count()), risk / len(RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts: dict[str, list[float | None]] = {name: [] for name in RULES}
            for row in batch.to_pylist():
                for name in RULES:
                    k = certified(row["size"], [row[f"{name}_{i}"] for i in range(len(GRID))], share, level)
                    cuts[name].append(None if k is None else GRID[k])
            yield pa.RecordBatch.from_arrays([batch.column("stratum"), *(pa.array(c, pa.float64()) for c in cuts.values())], names=["stratum", *(f"cut_{n}" for n in RULES)])

    return common.table(strata.mapInArrow(run, "stratum string, " + ", ".join(f"cut_{n} double" for n in RULES)), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the rules that rejected each document."""
    found = common.table(measured(docs), "measures")
    limits = found.groupBy("stratum").agg(F.count("*").alias("n")).join(cutoffs(found, labels, risk, delta), "stratum", "left")
    joined = common.keyed_join(found, limits, ["stratum"], found.count())
    broken = F.array_compact(F.array(*(F.when(F.expr(f"{rule} > cut_{name}"), F.lit(name)) for name, rule in RULES.items())))
    out = joined.withColumn("broken_rules", broken)
    return out.withColumn("kept", F.expr("not base_failed and size(broken_rules) = 0")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rules")
