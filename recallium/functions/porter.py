"""The stemmer of Porter (1980) for English words, on columns of terms."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The endings of the published algorithm and what takes their place, by step.
_STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _kinds(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return _kinds(word).count("vc")


def _closed(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _kinds(word).endswith("cvc") and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _longest(word: str, endings: list[tuple[str, str]], least: int) -> str:
    """The longest ending of those that the word has gives way if enough is left before it."""
    for ending, instead in sorted(endings, key=lambda e: -len(e[0])):
        if word.endswith(ending):
            rest = word[: -len(ending)]
            return rest + instead if _measure(rest) >= least else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters, or not of ASCII letters, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    for ending, instead in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            word = word[: -len(ending)] + instead
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for ending in ("ed", "ing"):
            rest = word[: -len(ending)]
            if word.endswith(ending) and "v" in _kinds(rest):
                if rest.endswith(("at", "bl", "iz")) or _measure(rest) == 1 and _closed(rest):
                    rest += "e"
                elif _doubled(rest) and rest[-1] not in "lsz":
                    rest = rest[:-1]
                word = rest
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(word, _STEP_2, 1)
    word = _longest(word, _STEP_3, 1)
    for ending in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(ending):
            rest = word[: -len(ending)]
            if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _closed(rest):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    """The stem of each term; each distinct one of a batch is stemmed once."""
    codes, distinct = pd.factorize(words)
    found = pd.Series([stem(w) for w in distinct] + [None], dtype=object)
    return pd.Series(found.to_numpy()[codes], index=words.index)  # a null has code -1


@F.pandas_udf(ArrayType(StringType()))
def stem_lists(lists: pd.Series) -> pd.Series:
    """The stems of each list of terms; each distinct term of a batch is stemmed once."""
    known = {w: stem(w) for w in set().union(*(set(ws) for ws in lists if ws is not None))}
    return lists.map(lambda ws: None if ws is None else [known[w] for w in ws])
