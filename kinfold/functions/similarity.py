"""Similarity of sets (JVM) and of strings (one Arrow UDF)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

RATIOS = ("name_levenshtein_ratio", "name_token_sort_ratio", "name_partial_ratio", "addr_levenshtein_ratio", "addr_token_sort_ratio")


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if a vector is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _subsequence(masks: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    full = (1 << size) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the lengths' sum; 0 if either is empty."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else 2 * _subsequence(_masks(a), len(a), b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a run of the longer one of at most its length."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 1.0
    masks, n = _masks(a), len(a)
    runs = {b[max(0, i) : i + n] for i in range(1 - n, len(b))}
    if len(a) == len(b):
        other = _masks(b)
        best = max(2 * _subsequence(other, n, r) / (n + len(r)) for r in {a[max(0, i) : i + n] for i in range(1 - n, n)})
    else:
        best = 0.0
    return max(best, max(2 * _subsequence(masks, n, r) / (n + len(r)) for r in runs))


def _points(strings: list[str]) -> np.ndarray:
    width = max(map(len, strings))
    return np.array(strings, dtype=f"U{width}").view(np.uint32).reshape(len(strings), width)


def _matches(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair and character of b, the places in a (at most 64) where it stands, as bits."""
    x, y = _points(a), _points(b)
    bits = np.left_shift(np.uint64(1), np.arange(x.shape[1], dtype=np.uint64))
    out = np.empty((len(a), y.shape[1]), np.uint64)
    for s in range(0, len(a), 256):
        same = (x[s : s + 256, :, None] == y[s : s + 256, None, :]) & (x[s : s + 256, :, None] != 0)
        out[s : s + 256] = (same * bits[None, :, None]).sum(axis=1, dtype=np.uint64)
    return out


def _step(s: np.ndarray, m: np.ndarray) -> np.ndarray:
    u = s & m
    return (s + u) | (s - u)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """ratio of each pair; pairs with a string of at most 64 characters all at once, a machine word a string."""
    out = np.zeros(len(a))
    small = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y or not x or not y:
            out[i] = float(bool(x) and x == y)
        elif min(len(x), len(y)) > 64 or max(len(x), len(y)) > 512:
            out[i] = ratio(x, y)
        else:
            small.append(i)
    for at in range(0, len(small), 4096):
        own = small[at : at + 4096]
        x = [min(a[i], b[i], key=len) for i in own]
        y = [max(b[i], a[i], key=len) for i in own]
        m = _matches(x, y)
        n, total = (np.array([len(s) for s in t]) for t in (x, y))
        s = np.full(len(own), np.iinfo(np.uint64).max, np.uint64)
        for j in range(m.shape[1]):
            s = _step(s, m[:, j])
        full = np.where(n == 64, np.iinfo(np.uint64).max, (np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1))
        common = n - np.bitwise_count(s & full)
        out[own] = 2 * common / (n + total)
    return out


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """partial_ratio of each pair; pairs whose shorter strings have one length (at most 64) all at once, with all their runs."""
    out = np.zeros(len(a))
    groups: dict[int, list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if not x or not y:
            continue
        if x in y or y in x:
            out[i] = 1.0
        elif min(len(x), len(y)) > 64 or max(len(x), len(y)) > 256:
            out[i] = partial_ratio(x, y)
        else:
            groups.setdefault(min(len(x), len(y)), []).append(i)
    for n, every in groups.items():
        full = np.uint64((1 << n) - 1)
        for at in range(0, len(every), 512):
            own = every[at : at + 512]
            sides = [(i, *sorted((a[i], b[i]), key=len)) for i in own]
            sides += [(i, y, x) for i, x, y in sides if len(x) == len(y)]
            x, y = [s[1] for s in sides], [s[2] for s in sides]
            m = _matches(x, y)
            size = np.array([len(s) for s in y])
            wide = np.concatenate([np.zeros((len(x), n - 1), np.uint64), m, np.zeros((len(x), n - 1), np.uint64)], axis=1)
            starts = m.shape[1] + n - 1
            s = np.full((len(x), starts), np.iinfo(np.uint64).max, np.uint64)
            for j in range(n):
                s = _step(s, wide[:, j : j + starts])
            common = n - np.bitwise_count(s & full).astype(np.int64)
            begin = np.arange(starts) - (n - 1)
            length = np.minimum(begin + n, size[:, None]) - np.maximum(begin, 0)
            value = np.where(length > 0, 2 * common / (n + np.maximum(length, 1)), 0.0).max(axis=1)
            np.maximum.at(out, [s[0] for s in sides], value)
    return out


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in RATIOS]))
def string_ratios(core_a: pd.Series, core_b: pd.Series, address_a: pd.Series, address_b: pd.Series) -> pd.DataFrame:
    a, b, c, d = (s.fillna("").tolist() for s in (core_a, core_b, address_a, address_b))
    ordered = lambda t: [" ".join(sorted(s.split())) for s in t]
    return pd.DataFrame(dict(zip(RATIOS, (ratios(a, b), ratios(ordered(a), ordered(b)), partial_ratios(a, b), ratios(c, d), ratios(ordered(c), ordered(d))), strict=True)))
