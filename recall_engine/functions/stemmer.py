"""The published Snowball algorithm for French, on words without accents.

Suffixes with accents never occur, as words are folded before they are stemmed; the others apply as published. A word
keeps its regions RV, R1 and R2 as start positions.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F, types as T

_VOWELS = frozenset("aeiouy")
# Endings of the published algorithm, longest first within a step.
_PLAIN = ("iqUes", "ances", "ismes", "ables", "istes", "ance", "iqUe", "isme", "able", "iste", "eux")
_ACTION = ("atrices", "ateurs", "ations", "atrice", "ateur", "ation")
_VERB_I = (
    "issaIent", "issantes", "issante", "issants", "issions", "iraIent", "issais", "issait", "issant", "issent", "issiez", "issons", "irions", "isses", "issez", "irais", "irait", "irent", "iriez", "irons", "iront",
    "isse", "irai", "iras", "irez", "ira", "ies", "ie", "Ie", "ir", "is", "it", "i",
)
_VERB_E = ("eraIent", "erions", "erais", "erait", "eriez", "erons", "eront", "erai", "eras", "erez", "era", "iez", "er", "ez")
_VERB_A = ("assions", "assent", "assiez", "aIent", "antes", "asses", "ante", "ants", "asse", "ais", "ait", "ant", "ai", "as", "a")


def _mark(word: str) -> str:
    """Upper case for i, u and y that act as consonants."""
    out = list(word)
    for i, c in enumerate(word):
        before = out[i - 1] if i else ""
        after = word[i + 1] if i + 1 < len(word) else ""
        if c in "ui" and before in _VOWELS and after in _VOWELS and before and after:
            out[i] = c.upper()
        elif c == "y" and ((before and before in _VOWELS) or (after and after in _VOWELS)):
            out[i] = "Y"
        elif c == "u" and before == "q":
            out[i] = "U"
    return "".join(out)


def _after_vowel_consonant(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) >= 2 and word[0] in _VOWELS and word[1] in _VOWELS or word[:3] in ("par", "col", "tap"):
        return min(3, len(word))
    return next((i + 1 for i in range(1, len(word)) if word[i] in _VOWELS), len(word))


def _ending(word: str, endings: tuple[str, ...], region: int = 0) -> str:
    return next((e for e in endings if word.endswith(e) and len(word) - len(e) >= region), "")


def _standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """Step 1: the word and whether a noun ending was removed; an adverb's ment does not count."""
    every = (*_PLAIN, *_ACTION, "logies", "logie", "usions", "utions", "usion", "ution", "ences", "ence", "issements", "issement", "ements", "ement", "ifs", "ives", "ive", "if", "eaux", "aux", "euses", "euse", "amment", "emment", "ments", "ment")
    e = max((x for x in every if w.endswith(x)), key=len, default="")
    if not e:
        return w, False
    at = len(w) - len(e)
    stem = w[:at]
    if e in _PLAIN:
        return (stem, True) if at >= r2 else (w, False)
    if e in _ACTION:
        if at < r2:
            return w, False
        if stem.endswith("ic"):
            return (stem[:-2] if at - 2 >= r2 else stem[:-2] + "iqU"), True
        return stem, True
    if e in ("logie", "logies"):
        return (stem + "log", True) if at >= r2 else (w, False)
    if e in ("usion", "ution", "usions", "utions"):
        return (stem + "u", True) if at >= r2 else (w, False)
    if e in ("ence", "ences"):
        return (stem + "ent", True) if at >= r2 else (w, False)
    if e in ("issement", "issements"):
        return (stem, True) if at >= r1 and stem and stem[-1] not in _VOWELS else _adverb(w, e, rv, r1, r2)
    if e in ("ement", "ements"):
        return _adverb(w, e, rv, r1, r2)
    if e in ("if", "ive", "ifs", "ives"):
        if at < r2:
            return w, False
        if stem.endswith("at") and at - 2 >= r2:
            stem = stem[:-2]
            if stem.endswith("ic"):
                stem = stem[:-2] if len(stem) - 2 >= r2 else stem[:-2] + "iqU"
        return stem, True
    if e == "eaux":
        return stem + "eau", True
    if e == "aux":
        return (stem + "al", True) if at >= r1 else (w, False)
    if e in ("euse", "euses"):
        return (stem, True) if at >= r2 else (stem + "eux", True) if at >= r1 else (w, False)
    if e in ("amment", "emment"):
        return (stem + ("ant" if e == "amment" else "ent"), False) if at >= rv else (w, False)
    return (stem, False) if at - 1 >= rv and stem and stem[-1] in _VOWELS else (w, False)


def _adverb(w: str, e: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    e = e[-6:] if e.endswith("s") else e[-5:]
    at = len(w) - len(e)
    if at < rv:
        return w, False
    stem = w[:at]
    if stem.endswith("iv") and at - 2 >= r2:
        stem = stem[:-2]
        return (stem[:-2] if stem.endswith("at") and len(stem) - 2 >= r2 else stem), True
    if stem.endswith("eus"):
        return (stem[:-3] if at - 3 >= r2 else stem[:-1] + "x" if at - 3 >= r1 else stem), True
    if stem.endswith(("abl", "iqU")) and at - 3 >= r2:
        return stem[:-3], True
    return stem, True


@lru_cache(200_000)
def stem(word: str) -> str:
    """Stem of a folded word."""
    w = _mark(word)
    rv, r1 = _rv(w), _after_vowel_consonant(w, 0)
    r2 = _after_vowel_consonant(w, r1)
    after, removed = _standard(w, rv, r1, r2)
    if not removed:
        before = after
        e = _ending(after, _VERB_I, rv)
        at = len(after) - len(e)
        if e and at - 1 >= rv and after[at - 1] not in _VOWELS:
            after = after[:at]
        elif after.endswith("ions") and len(after) - 4 >= max(rv, r2):
            after = after[:-4]
        elif e := _ending(after, _VERB_E, rv):
            after = after[: -len(e)]
        elif (e := _ending(after, _VERB_A, rv)) and not after.endswith("ions"):
            after = after[: -len(e)]
            if after.endswith("e") and len(after) - 1 >= rv:
                after = after[:-1]
        removed = after != before or after != w
    if removed:
        if after.endswith("Y"):
            after = after[:-1] + "i"
    else:
        if after.endswith("s") and len(after) > 1 and after[-2] not in "aious":
            after = after[:-1]
        if after.endswith("ion") and len(after) - 3 >= max(r2, rv) and len(after) - 4 >= rv and after[-4] in "st":
            after = after[:-3]
        elif (e := _ending(after, ("Ier", "ier"), rv)):
            after = after[: -len(e)] + "i"
        elif after.endswith("e") and len(after) - 1 >= rv:
            after = after[:-1]
    if after.endswith(("enn", "onn", "ett", "ell", "eill")):
        after = after[:-1]
    return after.lower()


@F.pandas_udf(T.StringType())
def stem_of(words: pd.Series) -> pd.Series:
    """Stem of each word of a vocabulary; null stays null."""
    return words.map(stem, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems_of(words: pd.Series) -> pd.Series:
    """Distinct stems of each list of words, in their order; null stays null."""
    return words.map(lambda ws: list(dict.fromkeys(map(stem, ws))), na_action="ignore")
