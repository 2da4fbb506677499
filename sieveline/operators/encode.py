"""Text encoders as Arrow-batched operators with a pluggable model.

A model is a callable factory, called once in each Python worker, that returns a function from
texts to a float matrix. Models are known by name; pre-trained weights aren't part of the package.
:func:`hashed_encoder` is a deterministic one that needs none, and :mod:`.contrastive` trains one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import clean

Encoder = Callable[[list[str]], np.ndarray]
PARAMS_CHARS = 500


@dataclass(frozen=True)
class EncoderConfig:
    """A model by name and revision, and how texts are given to it."""

    model: str = "hashed-64"
    revision: str = "1"
    max_tokens: int = 512
    params_chars: int = PARAMS_CHARS
    batch: int = 64
    query_filters: bool = True

    def passage_tag(self) -> str:
        """A key for stored vectors of passages: what queries are made of doesn't change them."""
        return f"{self.model.replace('/', '-')}@{self.revision}_t{self.max_tokens}_p{self.params_chars}"

    def tag(self) -> str:
        return self.passage_tag() + "_qf" * self.query_filters


#: Factories of known models: (name, revision) -> factory.
MODELS: dict[tuple[str, str], Callable[[], Encoder]] = {}


def register(name: str, revision: str, make: Callable[[], Encoder]) -> None:
    """Make a model known; another one under a known name and revision is refused."""
    if MODELS.setdefault((name, revision), make) is not make:
        raise ValueError(f"{name} {revision} is another model already")


def load_model(config: EncoderConfig) -> Callable[[], Encoder]:
    """The factory of the model that a configuration pins; texts are cut to its number of tokens."""
    if (config.model, config.revision) not in MODELS:
        raise ValueError(f"unknown model {config.model} {config.revision}; known: {sorted(MODELS)}")
    make, limit = MODELS[config.model, config.revision], config.max_tokens

    def cut() -> Encoder:
        model = make()
        return lambda texts: model([" ".join(t.split()[:limit]) for t in texts])

    return cut


def passage_text(title: Column, params: Column, description: Column, chars: int = PARAMS_CHARS) -> Column:
    return F.concat(F.lit("passage: "), F.concat_ws("\n", clean(title), clean(F.substring(params, 1, chars)), clean(description)))


def query_text(text: Column, filters: Column, with_filters: bool = True) -> Column:
    return F.concat(F.lit("query: "), F.concat_ws(". ", clean(text), clean(filters)) if with_filters else F.coalesce(clean(text), F.lit("")))


def hashed_encoder(width: int = 64) -> Callable[[], Encoder]:
    """Signed hashing of words and character trigrams, scaled to unit length."""

    def make() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for i, t in enumerate(texts):
                words = t.lower().split()
                for g in words + [w[k : k + 3] for w in words for k in range(len(w) - 2)]:
                    h = int.from_bytes(hashlib.md5(g.encode()).digest()[:4])
                    out[i, h % width] += 1 if h >> 31 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return encode

    return make


register("hashed-64", "1", hashed_encoder())


def encode(texts: DataFrame, key: str, text: str, make: Callable[[], Encoder] | None = None, batch: int = 256) -> DataFrame:
    """``key`` and the embedding of each row's text; a null text is an empty one. The key may be the text."""
    make = make or hashed_encoder()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(np.asarray(model(part["_text"].fillna("").tolist()), np.float32))})

    return texts.select(key, F.col(text).cast("string").alias("_text")).mapInPandas(run, f"`{key}` {dict(texts.dtypes)[key]}, embedding array<float>")


def truncation_share(texts: DataFrame, text: str, limit: int, count: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """Rows, and the share whose tokens exceed the limit; words count as tokens unless ``count`` is given."""
    if count is None:
        n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    else:
        counter = count

        @F.pandas_udf("long")
        def counted(s: pd.Series) -> pd.Series:
            return pd.Series(counter(s.fillna("").tolist()))

        n = counted(text)
    return texts.agg(F.count("*").alias("n"), F.avg((n > limit).cast("double")).alias("share"))
