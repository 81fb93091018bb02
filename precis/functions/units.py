"""Sentences and summaries of many documents at once, as numbered tokens: no list of terms is made for them.

A unit is a text of space-separated tokens. The last unit of a document is its summary. Terms are its tokens and, with ``max_n`` 2,
its pairs of neighbours; pairs are numbers, and only those that are counted by name ever become strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from precis.functions import bags


def joined(tokens: pa.Array) -> pa.Array:
    """Space-separated tokens of each list; a null list has none."""
    return pc.fill_null(pc.binary_join(tokens, " "), "")


class Units:
    """Tokens of the units of some documents: token ``i`` is ``names[code[i]]`` of unit ``unit[i]``."""

    def __init__(self, lists: pa.Array, max_n: int):
        sizes = bags._lengths(lists)
        self.sizes, self.n = sizes, int(sizes.sum())
        self.doc = np.repeat(np.arange(len(lists)), sizes)
        self.last = np.cumsum(sizes) - 1  # of documents without units the unit before
        texts = pc.fill_null(lists.flatten(), "")
        parts = pc.split_pattern(texts, " ")
        flat, lengths = parts.flatten(), bags._lengths(parts)
        kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        self.unit = np.repeat(np.arange(self.n), lengths)[kept]
        coded = flat.filter(pa.array(kept)).cast(pa.string()).dictionary_encode()
        self.names, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        same = self.unit[:-1] == self.unit[1:]
        self.first = np.flatnonzero(same) if max_n == 2 else np.empty(0, np.int64)

    def numbers(self) -> np.ndarray:
        """Position of each unit in its document, -1 for the summary."""
        at = np.arange(self.n)
        return np.where(at == self.last[self.doc], -1, at - (np.cumsum(self.sizes) - self.sizes)[self.doc])

    def times(self, summary_once: bool) -> np.ndarray:
        """How often each unit counts: a summary once, or once per sentence."""
        summary = np.arange(self.n) == self.last[self.doc]
        return np.where(summary, 1 if summary_once else self.sizes[self.doc] - 1, 1)

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all tokens and of all pairs."""
        hashed = bags.hashes(self.names)
        first, second = hashed[self.code[self.first]], hashed[self.code[self.first + 1]]
        pairs = bags._mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)
        return bags._bucket_of(hashed)[self.code], bags._bucket_of(pairs)

    def totals(self, summary_once: bool) -> np.ndarray:
        """Occurrences per bucket."""
        times = self.times(summary_once)
        of_tokens, of_pairs = self.buckets()
        both = np.concatenate([of_tokens, of_pairs])
        return np.bincount(
            both, np.concatenate([times[self.unit], times[self.unit[self.first]]]), 1 << bags.BUCKET_BITS
        ).astype(np.int64)

    def stats(self, kept: np.ndarray, summary_once: bool) -> pa.RecordBatch:
        """``term, df, total_tf`` of the terms of the ``kept`` buckets."""
        of_tokens, of_pairs = self.buckets()
        single, pair = np.flatnonzero(kept[of_tokens]), self.first[kept[of_pairs]]
        size = max(1, len(self.names))
        found, which = np.unique(self.code[pair] * size + self.code[pair + 1], return_inverse=True)
        named = pc.binary_join_element_wise(
            self.names.take(pa.array(found // size)), self.names.take(pa.array(found % size)), " "
        )
        names = pa.concat_arrays([self.names, named])
        unit = np.concatenate([self.unit[single], self.unit[pair]])
        keys, tf = np.unique(unit * len(names) + np.concatenate([self.code[single], size + which]), return_counts=True) \
            if len(unit) else (np.empty(0, np.int64), np.empty(0, np.int64))
        times, at = self.times(summary_once)[keys // max(1, len(names))], keys % max(1, len(names))
        there = np.unique(at)
        sums = [np.bincount(at, x, len(names))[there].astype(np.int64) for x in (times, times * tf)]
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(there)), *(pa.array(x) for x in sums)], ["term", "df", "total_tf"]
        )

    def sums(self, known: Known) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit the product with its summary and its own square, over the known terms."""
        word = known.places(self.names)[self.code]
        single = np.flatnonzero(known.values[word] > 0)
        pair = self.first[(word[self.first] < known.n_words) & (word[self.first + 1] < known.n_words)]
        hit, which = known.pairs_at(word[pair], word[pair + 1])
        term = np.concatenate([word[single], known.n_words + 1 + which])
        keys, tf = np.unique(np.concatenate([self.unit[single], self.unit[pair[hit]]]) * known.size + term, return_counts=True)
        unit, at = keys // known.size, keys % known.size
        square = known.values[at] ** 2
        own = np.bincount(unit, tf * tf * square, self.n)
        # Ascending by document and term, as there is one summary per document.
        by_doc = self.doc[unit] * known.size + at
        of_summary = unit == self.last[self.doc[unit]]
        summary_keys, summary_tf = by_doc[of_summary], tf[of_summary]
        place = np.searchsorted(summary_keys, by_doc)
        common = ~of_summary & (place < len(summary_keys))
        common[common] = summary_keys[place[common]] == by_doc[common]
        dot = np.bincount(unit[common], tf[common] * summary_tf[place[common]] * square[common], self.n)
        return dot.astype(float), own.astype(float)


class Known:
    """Terms with a value: those of one token have its place, those of two follow."""

    def __init__(self, terms: pa.Array, values: np.ndarray):
        names = terms.to_pylist()
        parts = [t.split(" ") for t in names]
        self.words = pa.array(sorted({w for p in parts for w in p}), pa.string())
        self.n_words = len(self.words)
        at = {w: i for i, w in enumerate(self.words.to_pylist())}
        pairs = sorted((at[p[0]] * self.n_words + at[p[1]], v) for p, v in zip(parts, values) if len(p) == 2)
        self.pairs = np.array([k for k, _ in pairs], np.int64)
        # One place more is for words that are not known.
        self.values = np.zeros(self.n_words + 1 + len(pairs))
        for p, v in zip(parts, values):
            if len(p) == 1:
                self.values[at[p[0]]] = v
        self.values[self.n_words + 1:] = [v for _, v in pairs]
        self.size = len(self.values)

    def places(self, names: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(names, value_set=self.words), self.n_words).to_numpy(zero_copy_only=False).astype(np.int64)

    def pairs_at(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.pairs):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys = first * self.n_words + second
        place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hit = np.flatnonzero(self.pairs[place] == keys)
        return hit, place[hit]


def pieces(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[tuple[pa.RecordBatch, Units]]:
    """Documents with their ``_units``, in runs of about ``bags.MOST_TOKENS`` tokens."""
    for batch in batches:
        lists = batch["_units"]
        lengths = pc.binary_length(pc.fill_null(lists.flatten(), "")).to_numpy(zero_copy_only=False)
        ends = bags._ends(lengths)[bags._ends(bags._lengths(lists))]
        # A token and its blank have three bytes at least.
        for i, j in bags.slices(lists, np.diff(ends) // 3):
            part = batch.slice(i, j - i)
            yield part, Units(part["_units"], max_n)
