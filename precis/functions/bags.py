"""Bags of terms of many rows at once, as Arrow arrays: tasks count whole batches by sorting numbers, not row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_TOKENS = 1 << 19  # tokens that are counted at once; a row is never cut
BUCKET_BITS = 20


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _lengths(lists: pa.Array) -> np.ndarray:
    """Length of each list; a null list has none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(lists: pa.Array) -> pa.Array:
    return lists.flatten()


def _as_lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """One list per owner 0 to n - 1; ``owner`` ascends."""
    offsets = _ends(np.bincount(owner, minlength=n)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


class Bags:
    """Terms of token lists in term order: entry ``i`` is term ``at[i]`` of ``names``, ``tf[i]`` times in list ``owner[i]``."""

    def __init__(self, tokens: pa.Array, max_n: int):
        lengths = _lengths(tokens)
        self.n = len(tokens)
        flat = _flat(tokens).cast(pa.string()).dictionary_encode()
        names, codes = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(self.n), lengths)
        if max_n == 2 and len(codes):
            first = np.flatnonzero(owner[:-1] == owner[1:])
            pairs, which = np.unique(codes[first] * len(names) + codes[first + 1], return_inverse=True)
            joined = pc.binary_join_element_wise(
                names.take(pa.array(pairs // len(names))), names.take(pa.array(pairs % len(names))), " "
            )
            codes, owner = np.concatenate([codes, len(names) + which]), np.concatenate([owner, owner[first]])
            names = pa.concat_arrays([names, joined])
        order = pc.sort_indices(names)
        rank = np.empty(len(names), np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        self.names, self.size = names.take(order), max(1, len(names))
        keys, tf = np.unique(owner * self.size + rank[codes], return_counts=True)
        self.owner, self.at, self.tf = keys // self.size, keys % self.size, tf.astype(np.int32)

    def lists(self) -> pa.ListArray:
        """``list<struct<term, tf>>`` per token list."""
        entries = pa.StructArray.from_arrays([self.names.take(pa.array(self.at)), pa.array(self.tf)], ["term", "tf"])
        return _as_lists(self.owner, self.n, entries)


def slices(lists: pa.Array, tokens_per_row: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``MOST_TOKENS`` tokens."""
    ends = _ends(tokens_per_row)
    start = 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + MOST_TOKENS, side="right")) - 1)
        yield start, min(stop, len(lists))
        start = min(stop, len(lists))


def counted(tokens: pa.Array, max_n: int) -> pa.Array:
    """The bag of each token list; a null list has an empty one."""
    parts = [Bags(tokens.slice(i, j - i), max_n).lists() for i, j in slices(tokens, _lengths(tokens))]
    return pa.concat_arrays(parts) if parts else Bags(tokens, max_n).lists()


def unit_batches(doc_ids: pa.Array, units: pa.Array, max_n: int) -> Iterator[pa.RecordBatch]:
    """Bags of the units of documents, the last of each its summary; see :func:`_units_of`."""
    ends = _ends(_lengths(_flat(units)))[_ends(_lengths(units))]
    for i, j in slices(units, np.diff(ends)):
        yield _units_of(doc_ids.slice(i, j - i), units.slice(i, j - i), max_n)


def _units_of(doc_ids: pa.Array, units: pa.Array, max_n: int) -> pa.RecordBatch:
    """One row per unit with its bag, and the terms it has in common with the summary with both counts."""
    n_units = _lengths(units)
    doc = np.repeat(np.arange(len(units)), n_units)
    bags, n = Bags(_flat(units), max_n), len(doc)
    last = np.cumsum(n_units) - 1
    entry_doc = doc[bags.owner]
    of_summary = bags.owner == last[entry_doc]
    # Ascending by document and term, as the summaries are in the order of their documents.
    keys = entry_doc * bags.size + bags.at
    summary_keys, summary_tf = keys[of_summary], bags.tf[of_summary]
    place = np.searchsorted(summary_keys, keys)
    hit = ~of_summary & (place < len(summary_keys))
    hit[hit] = summary_keys[place[hit]] == keys[hit]
    common = pa.StructArray.from_arrays(
        [bags.names.take(pa.array(bags.at[hit])), pa.array(bags.tf[hit]), pa.array(summary_tf[place[hit]])],
        ["term", "tf", "summary_tf"],
    )
    number = np.where(np.arange(n) == last[doc], -1, np.arange(n) - _ends(n_units)[doc])
    return pa.RecordBatch.from_arrays(
        [
            doc_ids.take(pa.array(doc)), pa.array((n_units[doc] - 1).astype(np.int32)), pa.array(number.astype(np.int32)),
            bags.lists(), _as_lists(bags.owner[hit], n, common),
        ],
        ["doc_id", "n_sentences", "sentence_id", "terms", "_common"],
    )


def entries(terms: pa.Array, *counts: str) -> tuple:
    """Row, term and counts of all entries of ``list<struct<term, ..>>``."""
    flat = _flat(terms)
    rows = np.repeat(np.arange(len(terms)), _lengths(terms))
    return rows, flat.field("term"), *(flat.field(c).to_numpy(zero_copy_only=False) for c in counts)


def values_of(terms: pa.Array, names: pa.Array, values: np.ndarray) -> np.ndarray:
    """The value of each term, 0 for those that are not among ``names``."""
    at = pc.fill_null(pc.index_in(terms.cast(names.type), value_set=names), -1).to_numpy(zero_copy_only=False)
    return np.concatenate([values, [0.0]])[at]


def buckets(terms: pa.Array) -> np.ndarray:
    """A number below ``2 ** BUCKET_BITS`` for each string."""
    return _bucket_of(hashes(terms))


def _bucket_of(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def hashes(terms: pa.Array) -> np.ndarray:
    """64 bits for each string, from a polynomial of its bytes."""
    if not len(terms):
        return np.empty(0, np.uint64)
    terms = pc.cast(terms, pa.binary())
    lengths = pc.binary_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = _ends(lengths)
    size = int(ends[-1])
    first = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset]
    data = np.frombuffer(terms.buffers()[2], np.uint8)[first:first + size].astype(np.uint64) + np.uint64(1)
    place = np.arange(size) - np.repeat(ends[:-1], lengths)
    powers = np.full(int(lengths.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64).cumprod()
    sums = np.concatenate([[np.uint64(0)], np.cumsum(data * powers[place])])
    return _mixed(sums[ends[1:]] - sums[ends[:-1]])


def _mixed(values: np.ndarray) -> np.ndarray:
    hashed = values * np.uint64(0xD6E8FEB86659FD93)
    hashed ^= hashed >> np.uint64(32)
    return hashed * np.uint64(0xD6E8FEB86659FD93)


def gathered(batches: Iterator[pa.RecordBatch], n: int = MOST_TOKENS) -> Iterator[pa.RecordBatch]:
    """Batches joined to such of about ``n`` terms."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(_lengths(batch["terms"]).sum())
        if size >= n:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
