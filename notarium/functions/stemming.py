"""English terms for full-text search: stop words removed and words stemmed by Porter's published algorithm (1980).

The stemmer runs once per distinct word in Arrow batches; use it on a table of distinct terms and join.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stop words of English full-text search, as fixed values.
STOP_WORDS = frozenset(
    (
        "a about above after again against all am an and any are as at be because been before being below between both but by "
        "can did do does doing don down during each few for from further had has have having he her here hers herself him "
        "himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
        "our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there "
        "these they this those through to too under until up very was we were what when where which while who whom why will "
        "with you your yours yourself yourselves"
    ).split()
)
_VOWEL = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    return c not in _VOWEL and (c != "y" or i == 0 or not _cons(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c", shape))


def _vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _cons(w, n - 1) and not _cons(w, n - 2) and _cons(w, n - 3) and w[-1] not in "wxy"


#: Endings and what replaces them, as the algorithm gives them.
_STEP2 = (
    "ational ate|tional tion|enci ence|anci ance|izer ize|abli able|alli al|entli ent|eli e|ousli ous|ization ize|ation ate|"
    "ator ate|alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble"
)
_STEP3 = "icate ic|ative |alize al|iciti ic|ical ic|ful |ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def stem(word: str) -> str:
    """The stem of a lower-case English word; other words come back as they are."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for ending in ("ed", "ing"):
            if w.endswith(ending) and _vowel(w[: -len(ending)]):
                w = w[: -len(ending)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for ending, other in sorted((x.split(" ") for x in table.split("|")), key=lambda x: -len(x[0])):
            if w.endswith(ending):
                if _measure(w[: -len(ending)]) > 0:
                    w = w[: -len(ending)] + other
                break
    for ending in sorted([*_STEP4.split(), "ion"], key=lambda x: -len(x)):
        if w.endswith(ending):
            base = w[: -len(ending)]
            if _measure(base) > 1 and (ending != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def english_term(terms: pd.Series) -> pd.Series:
    """The stem of each term; null for stop words and nulls."""
    return terms.map(lambda t: None if t is None or t in STOP_WORDS else stem(t))
