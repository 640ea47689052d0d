"""The index form of words: diacritics dropped, underscores split, Porter's stem. One Arrow-batched function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NEAR, _FAR = (re.compile("[" + "".join(f"\\U{c:08x}" for c in range(*own) if unicodedata.combining(chr(c))) + "]+") for own in ((0x300, 0x370), (0x370, 0x110000)))
_BEYOND = re.compile("[\u0370-\U0010ffff]")
_WORDS = re.compile(r"[^\W_]+")
_SHAPE = str.maketrans("abcdefghijklmnopqrstuvwxz", "".join("v" if ch in "aeiou" else "c" for ch in "abcdefghijklmnopqrstuvwxz"))


def fold(text: str) -> list[str]:
    """Words without diacritics; an underscore separates words."""
    plain = text.lower()
    if not plain.isascii():
        plain = _NEAR.sub("", unicodedata.normalize("NFD", plain))
        if _BEYOND.search(plain):
            plain = _FAR.sub("", plain)
    return _WORDS.findall(plain)


def _shape(s: str) -> str:
    """c for each consonant, v for each vowel; y after a consonant is a vowel."""
    shape = s.translate(_SHAPE)
    while (i := shape.find("y")) >= 0:
        shape = shape[:i] + ("v" if i > 0 and shape[i - 1] == "c" else "c") + shape[i + 1 :]
    return shape


def _measure(s: str) -> int:
    return _shape(s).count("vc")


def _has_vowel(s: str) -> bool:
    return "v" in _shape(s)


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"


def _short(s: str) -> bool:
    return len(s) > 2 and _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
          ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ment", "ance", "ence", "able", "ible", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


def _by_last(rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """Rules by their ending's last letter, the longest first."""
    return {ch: sorted((r for r in rules if r[0][-1] == ch), key=lambda r: -len(r[0])) for ch in {r[0][-1] for r in rules}}


_AT2, _AT3, _AT4 = _by_last(_STEP2), _by_last(_STEP3), _by_last([(end, "") for end in _STEP4])


def porter(w: str) -> str:
    """Porter's stem of an ASCII word; others stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_AT2, _AT3):
        for end, new in rules.get(w[-1:], ()):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end, _ in _AT4.get(w[-1:], ()):
        if w.endswith(end):
            rest = w[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e"):
        rest = w[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            w = rest
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


class _Stems(dict):
    """Stems of words, filled as words are met."""

    def __missing__(self, w: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[w] = stem = porter(w)
        return stem


_known = _Stems()


def index_words(text: str) -> list[str]:
    """The index form of a text's words, in order."""
    return list(map(_known.__getitem__, fold(text)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else index_words(t))


def stems(c: Column) -> Column:
    """The index form of a text column's words."""
    return _stems(c)
