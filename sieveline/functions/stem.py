"""The Snowball stemmer for Russian, applied to a vocabulary and not to every word of a text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = "аеиоуыэюя"

# The endings of the published algorithm; those of a first group must follow а or я.
PERFECTIVE = (["в", "вши", "вшись"], ["ив", "ивши", "ившись", "ыв", "ывши", "ывшись"])
REFLEXIVE = ["ся", "сь"]
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE = (["ем", "нн", "вш", "ющ", "щ"], ["ивш", "ывш", "ующ"])
VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
DERIVATIONAL = ["ост", "ость"]
SUPERLATIVE = ["ейш", "ейше"]


def _cut(word: str, start: int, endings: list[str], after: str = "") -> str | None:
    """The word without its longest ending inside the region from ``start``, None if there is none."""
    for e in sorted(endings, key=len, reverse=True):
        if word.endswith(e) and len(word) - len(e) >= start:
            left = word[: len(word) - len(e)]
            if not after:
                return left
            if left[start:] and left[-1] in after:
                return left
    return None


def _either(word: str, start: int, groups: tuple[list[str], list[str]]) -> str | None:
    """Endings of the second group, or of the first after а or я; the longer one found wins."""
    found = [x for x in (_cut(word, start, groups[1]), _cut(word, start, groups[0], "ая")) if x is not None]
    return min(found, key=len) if found else None


def _regions(word: str) -> tuple[int, int]:
    """Start of the part after the first vowel, and of the part after a second consonant that follows a vowel."""
    rv = next((i + 1 for i, c in enumerate(word) if c in VOWELS), len(word))

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    return rv, after(after(0))


def stem(word: str) -> str:
    """The stem of one lower-case word; other scripts stay as they are."""
    word = word.replace("ё", "е")
    rv, r2 = _regions(word)
    if (cut := _either(word, rv, PERFECTIVE)) is not None:
        word = cut
    else:
        word = _cut(word, rv, REFLEXIVE) or word
        adjective = _cut(word, rv, ADJECTIVE)
        if adjective is not None:
            cut = _either(adjective, rv, PARTICIPLE)
            word = adjective if cut is None else cut
        elif (cut := _either(word, rv, VERB)) is not None or (cut := _cut(word, rv, NOUN)) is not None:
            word = cut
    word = word[:-1] if word.endswith("и") and len(word) > rv else word
    cut = _cut(word, r2, DERIVATIONAL)
    word = word if cut is None else cut
    if word.endswith("нн") and len(word) - 2 >= rv:
        return word[:-1]
    cut = _cut(word, rv, SUPERLATIVE)
    if cut is not None:
        return cut[:-1] if cut.endswith("нн") and len(cut) - 2 >= rv else cut
    return word[:-1] if word.endswith("ь") and len(word) > rv else word


def stemmed_vocabulary(words: DataFrame, column: str = "word") -> DataFrame:
    """``column`` and ``stem`` of each distinct word of ``words``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(stem=b[column].map(stem))

    return words.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"{column} string, stem string")


@lru_cache(1 << 18)
def _remembered(word: str) -> str:
    return stem(word)


def stem_set(words: Column) -> Column:
    """The distinct stems of an array of words; a worker remembers the stems of words it has met."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda ws: sorted({_remembered(w) for w in ws}))

    return F.pandas_udf(run, "array<string>")(words)
