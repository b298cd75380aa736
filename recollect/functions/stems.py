"""Words of texts as a full-text index keeps them: folded, without diacritics, stemmed by Porter's algorithm of 1980."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix tables of the published algorithm, with its author's later `logi` and `bli`.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
LEAST, MOST = 3, 64  # lengths of words that are stemmed

_WORD = regex.compile(r"[\p{L}\p{N}\p{Co}]+")


def _shape(word: str) -> str:
    """A letter a character: v for vowels, c for consonants; y is a vowel behind a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(1 << 18)
def stem(word: str) -> str:
    """Works on bytes: those of other alphabets are consonants."""
    raw = word.encode()
    return _stem(raw.decode("latin-1")).encode("latin-1").decode("utf-8", "ignore") if LEAST <= len(raw) <= MOST else word


def _stem(word: str) -> str:
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word[1:].endswith(("sses", "ies")) else word[:-1]
    if len(word) > 3 and word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (end := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _shape(word).endswith("cc") and word[-1] == word[-2] and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = _longest(word, STEP_4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def words(text: str) -> list[str]:
    """Folded words in order, not stemmed."""
    plain = "".join(x for x in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(x) != "Mn")
    return _WORD.findall(plain)


def stems(text: str | None) -> list[str]:
    return [stem(w) for w in words(text or "")]


def stems_column(text: Column) -> Column:
    """array<string> of a text's stems in order; null gives none. Meant for a table written once, not for each search."""
    return F.pandas_udf(lambda s: s.map(stems), "array<string>")(text)
