"""Common tokens of many text pairs at once: clipped n-gram overlaps and longest common subsequences.

A batch becomes numbers once; only the subsequences, and the stem of each different word, are left to Python loops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from precis.functions import lcs, stemming

MOST_BYTES = 1 << 23  # text of the candidates that is looked at together; a pair is never cut


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and text of each token; an empty text has none."""
    lists = pc.split_pattern(texts, " ")
    flat, lengths = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(texts)), lengths)[kept], flat.filter(pa.array(kept))


def _lookup(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys there are, and the places of these."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    hit = np.flatnonzero(sorted_keys[place] == keys)
    return hit, place[hit]


class _Pairs:
    """Candidates and references as numbered tokens. ``keys`` are the references' (row, token), ascending."""

    def __init__(self, candidates: pa.Array, references: pa.Array, stems: dict[str, str] | None):
        self.n = len(candidates)
        (self.row, words), (self.ref_row, ref_words) = _tokens(candidates), _tokens(references)
        coded = pa.concat_arrays([words, ref_words]).dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        if stems is not None:
            again = pa.array([stems[w] for w in names.to_pylist()], pa.string()).dictionary_encode()
            codes, names = again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], again.dictionary
        self.size = max(1, len(names))
        self.code, self.ref_code = codes[: len(words)], codes[len(words):]
        self.wanted = np.zeros(self.size, bool)
        self.wanted[self.ref_code] = True
        self.keys, self.ref_at, self.ref_tf = np.unique(
            self.ref_row * self.size + self.ref_code, return_inverse=True, return_counts=True
        )
        known = np.flatnonzero(self.wanted[self.code])
        hit, self.at = _lookup(self.keys, self.row[known] * self.size + self.code[known])
        self.at_row = self.row[known[hit]]

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.row, minlength=self.n), np.bincount(self.ref_row, minlength=self.n)

    def overlap1(self) -> np.ndarray:
        common = np.minimum(np.bincount(self.at, minlength=len(self.keys)), self.ref_tf)
        return np.bincount(self.keys // self.size, common, self.n)

    def overlap2(self) -> np.ndarray:
        ref_first = np.flatnonzero(self.ref_row[:-1] == self.ref_row[1:])
        names, ref_pair = np.unique(
            self.ref_code[ref_first] * self.size + self.ref_code[ref_first + 1], return_inverse=True
        )
        known = self.wanted[self.code]
        first = np.flatnonzero((self.row[:-1] == self.row[1:]) & known[:-1] & known[1:])
        hit, pair = _lookup(names, self.code[first] * self.size + self.code[first + 1])
        size = max(1, len(names))
        keys, tf = np.unique(self.ref_row[ref_first] * size + ref_pair, return_counts=True)
        _, at = _lookup(keys, self.row[first[hit]] * size + pair)
        return np.bincount(keys // size, np.minimum(np.bincount(at, minlength=len(keys)), tf), self.n)

    def subsequence(self) -> np.ndarray:
        """Only tokens found on both sides can count."""
        shared = np.zeros(len(self.keys), bool)
        shared[self.at] = True
        kept = shared[self.ref_at]
        both = []
        for rows, at in ((self.at_row, self.at), (self.ref_row[kept], self.ref_at[kept])):
            both.append((np.searchsorted(rows, np.arange(self.n + 1)).tolist(), at.tolist()))
        (ends, tokens), (ref_ends, ref_tokens) = both
        found = np.zeros(self.n, np.int64)
        for i in np.unique(self.at_row).tolist():
            found[i] = lcs.length_of_shared(tokens[ends[i]:ends[i + 1]], ref_tokens[ref_ends[i]:ref_ends[i + 1]])
        return found


def _slices(candidates: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.binary_length(candidates).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(candidates):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + MOST_BYTES, side="right")))
        yield start, stop - start
        start = stop


COUNTS = {"rouge1": _Pairs.overlap1, "rouge2": _Pairs.overlap2, "rougeL": _Pairs.subsequence}


def counts(batches: Iterator[tuple[pa.Array, pa.Array]], metrics: list[str], stem: bool) -> Iterator[pa.Array]:
    """See :func:`common`; a task stems each word once."""
    stems = stemming.Stems() if stem else None
    kind = pa.struct([(n, pa.int32()) for n in ("n", "n_reference", *metrics)])
    for candidates, references in batches:
        parts = [pa.array([], kind)]
        for start, size in _slices(candidates):
            pairs = _Pairs(candidates.slice(start, size), references.slice(start, size), stems)
            values = [*pairs.lengths(), *(COUNTS[m](pairs) for m in metrics)]
            parts.append(pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in values], fields=list(kind)))
        yield pa.concat_arrays(parts)


def common(metrics: tuple[str, ...], stem: bool) -> Callable:
    """UDF of two texts of space-separated tokens: tokens of each side, and what they have in common by metric.

    ``stem`` compares the stems of the tokens.
    """
    names = [m for m in COUNTS if m in metrics]

    @F.arrow_udf(", ".join(f"{n} int" for n in ("n", "n_reference", *names)))
    def counted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return counts(batches, names, stem)

    return counted
