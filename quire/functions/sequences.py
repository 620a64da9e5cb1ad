"""Sequence metrics that no built-in function has, as Arrow-batched pandas UDFs: word errors, edit scripts, similarity ratios."""

from __future__ import annotations

import math
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = re.compile(r"\w+")


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences by bit vectors: one step per element of b, whatever the length of a."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for x in b:
        equal = masks.get(x, 0)
        cross = equal | minus
        equal |= (((equal & plus) + plus) ^ plus) & full
        up, down = minus | (~(equal | plus) & full), plus & equal
        score += 1 if up & high else -1 if down & high else 0
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus, minus = down | (~(cross | up) & full), up & cross
    return score


def tokens(text: str | None) -> list[str]:
    """Lower-case words after compatibility decomposition, whose marks part words."""
    return TOKENS.findall(re.sub("[–—]", "-", unicodedata.normalize("NFKD", text or "").lower()))


def word_error_rate(reference: list, hypothesis: list) -> float:
    if not reference:
        return 1.0 if hypothesis else 0.0
    return min(1.0, edit_distance(reference, hypothesis) / len(reference)) if hypothesis else 1.0


def script_counts(a, b) -> tuple[int, int, int]:
    """Substitutions, insertions and deletions that the matching blocks of the two sequences leave."""
    subs = ins = dels = 0
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, b).get_opcodes():
        if tag != "equal":
            m, n = i2 - i1, j2 - j1
            subs, ins, dels = subs + min(m, n), ins + max(0, n - m), dels + max(0, m - n)
    return subs, ins, dels


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_two_sided(t: float, freedom: float) -> float:
    """Two-sided p value of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + top * d, 1 + top / c
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


@F.pandas_udf(T.DoubleType())
def wer(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([word_error_rate(tokens(a), tokens(b)) for a, b in zip(reference, hypothesis, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("substitutions", "insertions", "deletions", "total")]))
def edit_counts(reference: pd.Series, hypothesis: pd.Series, words: pd.Series) -> pd.DataFrame:
    """By words, or by characters where words is false."""
    rows = []
    for a, b, by_word in zip(reference, hypothesis, words, strict=True):
        a, b = (a or "").split() if by_word else list(a or ""), (b or "").split() if by_word else list(b or "")
        rows.append((*script_counts(a, b), len(a)))
    return pd.DataFrame(rows, columns=["substitutions", "insertions", "deletions", "total"])


@F.pandas_udf(T.DoubleType())
def t_test(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(x, k - 1) if pd.notna(x) and k > 1 else None for x, k in zip(t, n, strict=True)], dtype="float64")


def _quantile(level: float, freedom: float) -> float:
    """The t that the given share of values lies within, by halving."""
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if 1 - t_two_sided(middle, freedom) > level else (middle, high)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_quantile(level: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_quantile(p, k - 1) if pd.notna(k) and k > 1 else None for p, k in zip(level, n, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def z_test(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else normal_two_sided(x) for x in z], dtype="float64")
