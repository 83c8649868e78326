"""Words for the text index: accents, stop words and the Porter (1980) stemmer, written from the published rules."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Common English words that are not indexed; pass another set where a different list is wanted.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been before being but by can could did do does for from had has have he her here him his how i if in into is it its just me more most my no nor not now of on only or other our out over own s same she so some such t than that the their them then there these they this those through to too under up very was we were what when where which while who whom why will with would you your".split()
)


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def unaccented(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t if t.isascii() else strip_accents(t))


def _shape(word: str) -> str:
    """The word as c and v."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _ends_double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _ends_cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def porter(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif (s := _longest(w, ("ed", "ing"))) and _has_vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _ends_double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _ends_cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    if s := _longest(w, STEP4):
        stem = w[: -len(s)]
        if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _ends_cvc(w[:-1]):
            w = w[:-1]
    if _measure(w) > 1 and _ends_double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else porter(w))
