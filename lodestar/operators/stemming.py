"""An English analyser: possessives, stop words and Porter's stemmer, in an Arrow UDF."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The stop words of the analyser.
STOP_WORDS = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
VOWELS = "aeiou"
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(word: str) -> str:
    """v and c for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in VOWELS or c == "y" and i and out[-1] == "c" else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def short_end(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def replaced(word: str, endings: dict[str, str]) -> str:
    for end in sorted(endings, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + endings[end] if measure(stem) > 0 else word
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in shape(word[: -len(e)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif shape(word)[-2:] == "cc" and word[-1] == word[-2] and word[-1] not in "lsz":
                word = word[:-1]
            elif measure(word) == 1 and short_end(word):
                word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP2), STEP3)
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            base = word[: -len(end)]
            if measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not short_end(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def tokens(text: str | None) -> list[str]:
    found = re.findall(r"\w+(?:['’]\w+)*", (text or "").lower())
    plain = (re.sub(r"['’]s$", "", w) for w in found)
    return [stem(w) for w in plain if w and w not in STOP_WORDS]


@F.pandas_udf(ArrayType(StringType()))
def english(texts: pd.Series) -> pd.Series:
    return texts.map(tokens)
