"""Longest common subsequence of token sequences, bit-parallel (Crochemore et al. 2001, Hyyro 2004)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _masks(tokens: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, token in enumerate(tokens):
        out[token] = out.get(token, 0) | (1 << i)
    return out


def _length(masks: dict[str, int], width: int, tokens: list[str]) -> int:
    full = (1 << width) - 1
    open_bits = full
    for token in tokens:
        mask = masks.get(token)
        if mask:
            hit = open_bits & mask
            open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return width - open_bits.bit_count()


def lcs_length(a: list[str], b: list[str]) -> int:
    """Only tokens found on both sides can count, so the rest is left out before the bit loop."""
    shared = set(a) & set(b)
    if not shared:
        return 0
    return length_of_shared([t for t in a if t in shared], [t for t in b if t in shared])


def length_of_shared(a: list, b: list) -> int:
    """The same for sequences without any token that only one side has."""
    if len(a) > len(b):
        a, b = b, a
    return _length(_masks(a), len(a), b)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def lcs_lines(lines: pd.Series, reference: pd.Series) -> pd.Series:
    """LCS length of every line of a text with one reference, whose bit masks are built once."""

    def one(text: str, ref: str) -> list[int]:
        tokens = ref.split()
        masks, width = _masks(tokens), len(tokens)
        return [_length(masks, width, line.split()) for line in text.split("\n")]

    return pd.Series([one(t, r) for t, r in zip(lines, reference)])
