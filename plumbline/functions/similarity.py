"""Fuzzy containment of a value in a text: best-window similarity by longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lcs(masks: dict[str, int], full: int, window: str) -> int:
    """Length of the longest common subsequence of a text (as bit masks of its characters) and a window."""
    row = full
    for c in window:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return (full & ~row).bit_count()


def _prepared(text: str) -> tuple[dict[str, int], int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks, (1 << len(text)) - 1


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths."""
    if not a and not b:
        return 1.0
    return 2 * _lcs(*_prepared(a), b) / (len(a) + len(b))


def _best(needle: str, hay: str) -> float:
    """Best ratio of the needle with a window of its length, or a shorter one at either end."""
    masks, full = _prepared(needle)
    m, n, best = len(needle), len(hay), 0.0
    ends = [(max(0, e - m), min(e, n)) for e in range(1, n + m)]
    for a, b in ends:
        # a window that ends (or, at the end of the text, begins) beside the needle's characters is never the best
        if hay[b - 1] not in masks and b < n or 2 * min(m, b - a) <= best * (m + b - a):
            continue
        best = max(best, 2 * _lcs(masks, full, hay[a:b]) / (m + b - a))
        if best == 1.0:
            break
    return best


def partial_ratio(a: str, b: str) -> float:
    """Similarity, 0 to 1, of the shorter text with the best part of the longer."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    score = _best(a, b)
    return max(score, _best(b, a)) if len(a) == len(b) and score < 1.0 else score


def best_window(value: str, text: str, slack: int = 12) -> str | None:
    """The part of a text, ``slack`` longer than the value, most like it; parts a quarter of their length apart."""
    width = len(value) + slack
    if width >= len(text):
        return text.strip() or None
    folded, (masks, full) = value.casefold(), _prepared(value.casefold())
    best, found = 0.0, None
    for at in range(0, len(text) - width + 1, max(1, width // 4)):
        part = text[at : at + width]
        low = part.casefold()
        score = 2 * _lcs(masks, full, low) / (len(folded) + len(low))
        if score > best:
            best, found = score, part
    return found.strip() if found else None


@F.pandas_udf(T.StructType().add("score", T.DoubleType()).add("quote", T.StringType()))
def fuzzy_ground(value: pd.Series, text: pd.Series, min_ratio: pd.Series, slack: pd.Series) -> pd.DataFrame:
    """Unrounded best score of each value in its text, and the best window where it reaches ``min_ratio``; null in, null out."""
    out = []
    for v, t, m, k in zip(value, text, min_ratio, slack, strict=True):
        if v is None or t is None:
            out.append((None, None))
            continue
        score = partial_ratio(v.casefold(), t.casefold())
        out.append((score, best_window(v, t, int(k)) if score >= m else None))
    return pd.DataFrame(out, columns=["score", "quote"])


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
