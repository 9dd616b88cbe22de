"""The Porter stemmer (with the published revisions bli -> ble and logi -> log) and its use on columns.

A word is looked at through its shape, a string of c and v for consonants and vowels; the measure of a stem is
the number of times that vc occurs in its shape.
"""

from __future__ import annotations

from functools import lru_cache

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# The suffix rules of the published algorithm, longest first where one ends another.
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
SINGLE_SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
DROPPED_SUFFIXES = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or letter == "y" and out[-1:] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _ends_cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _plurals_and_participles(word: str) -> str:
    word = re.sub("(?<=ss)es$|(?<=i)es$|(?<!s)s$", "", word)
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    stem = re.sub("(?:ed|ing)$", "", word)
    if stem == word or "v" not in _shape(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _ends_double(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem


def _replace(word: str, rules: dict[str, str]) -> str:
    suffix = _longest(word, rules)
    if suffix is None:
        return word
    stem = word[: len(word) - len(suffix)]
    return stem + rules[suffix] if _measure(stem) else word


def porter_stem(word: str | None) -> str | None:
    """The stem of a lower-case word; words of up to two letters, the empty word and None stay."""
    if word is None or len(word) <= 2:
        return word
    word = _plurals_and_participles(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, DOUBLE_SUFFIXES)
    word = _replace(word, SINGLE_SUFFIXES)
    suffix = _longest(word, DROPPED_SUFFIXES)
    if suffix:
        stem = word[: len(word) - len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    size = _measure(word)
    if word.endswith("e") and (size > 1 or size == 1 and not _ends_cvc(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and size > 1 else word


@lru_cache(maxsize=100_000)
def _remembered(word: str | None) -> str | None:
    return porter_stem(word)


def _stems():
    @F.pandas_udf("string")
    def stems(values):
        return values.map({w: _remembered(w) for w in values.unique()})

    return stems


def stem_table(words: DataFrame, column: str) -> DataFrame:
    """(word, stem) for the distinct lower-cased values of a column."""
    ship(words.sparkSession)
    distinct = words.select(F.lower(column).alias("word")).filter(F.col("word").isNotNull()).distinct()
    return distinct.select("word", _stems()("word").alias("stem"))


def with_stem(df: DataFrame, column: str, stem: str) -> DataFrame:
    """df with the stem of a column's lower-cased value; null stays null. One pass: a batch's distinct words are stemmed, each once for a worker."""
    ship(df.sparkSession)
    return df.withColumn(stem, _stems()(F.lower(column)))
