"""Small tables and brute-force versions for the corpus operators."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """rows: (doc_id, text[, lang]); ``extra`` adds columns whose names clash with operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    if extra:
        for name in ("id", "key", "class_id", "n_tokens", "start", "score", "lang_pred", "quality_score", "row", "h", "batch", "a", "b", "kept"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
    return df


def prose(seed, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(words) for _ in range(n))


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


ODD = [(None, "no id at all"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "twice the same"), (5, "twice the same"), (6, "nb sp 　 wide \x0b \x1f \x85 end  two   three"), (7, "<|endoftext|> in <|startoftext|>text"), (8, "a" * 5000 + " " + "long " * 4000)]
