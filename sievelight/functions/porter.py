"""The Porter stemmer, after the published algorithm of 1980, as an Arrow UDF for distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The algorithm's suffix tables.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")



def _pattern(stem: str) -> str:
    """v for vowels (y after a consonant too), c for consonants."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _pattern(stem)))


def _vowel(stem: str) -> bool:
    return "v" in _pattern(stem)


def _short(stem: str) -> bool:
    return _pattern(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x) and _vowel(word[: -len(x)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _pattern(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2, 0), _STEP3, 0)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root.endswith(("s", "t"))):
                word = root
            break
    if word.endswith("e"):
        root = word[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _short(root)):
            word = root
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stems(terms: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms: stemming runs once a term, not once an occurrence."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem)

    distinct = terms.select(F.col(column).alias("term")).distinct()
    return distinct.select("term", run("term").alias("stem"))


def stems_among(words: Column, wanted: list[str]) -> Column:
    """Which of some stems an array of words has, once for each word that has it.

    A stem keeps its word's first letter, so only words that begin like one of the stems go to Python, where each distinct word of a
    batch is stemmed once.
    """

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        known = {w: s for w in set().union(*rows) if (s := stem(w)) in want}
        return rows.map(lambda ws: [known[w] for w in ws if w in known])

    want = frozenset(wanted)
    return run(F.filter(words, lambda w: F.substring(w, 1, 1).isin(*sorted({s[0] for s in want}))))
