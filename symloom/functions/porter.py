"""The Porter stemmer, after the published algorithm of 1980."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _cons(w: str, i: int) -> bool:
    c = w[i]
    return not (c in "aeiou" or (c == "y" and i > 0 and _cons(w, i - 1)))


def _measure(s: str) -> int:
    kinds = [_cons(s, i) for i in range(len(s))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _vowel(s: str) -> bool:
    return any(not _cons(s, i) for i in range(len(s)))


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and _cons(s, len(s) - 1)


def _cvc(s: str) -> bool:
    n = len(s)
    return n > 2 and _cons(s, n - 3) and not _cons(s, n - 2) and _cons(s, n - 1) and s[-1] not in "wxy"


# The suffix tables of the published algorithm.
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _swap(w: str, table: dict[str, str]) -> str:
    for end in sorted((e for e in table if w.endswith(e)), key=len, reverse=True)[:1]:
        base = w[: len(w) - len(end)]
        return base + table[end] if _measure(base) > 0 else w
    return w


def stem(w: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for end in sorted((e for e in STEP4 if w.endswith(e)), key=len, reverse=True)[:1]:
        base = w[: len(w) - len(end)]
        if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
            w = base
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def porter(s: pd.Series) -> pd.Series:
    """Stems of a column of words; each distinct word is stemmed once a batch."""
    known = {w: stem(w) for w in s.dropna().unique()}
    return s.map(known)
