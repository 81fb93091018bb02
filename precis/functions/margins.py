"""Linear losses over numbered rows, by Arrow batches: ``label, c, at, x`` with the places and values of a row's terms.

The last parameter is the intercept, which every row has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from precis.functions import bags, lookup, network


def numbered(terms: pa.Array, hashes: np.ndarray) -> pa.StructArray:
    """Places and values of ``list<struct<term, x>>``; every term is known."""
    offsets = pa.array(bags._ends(bags._lengths(terms)).astype(np.int32))
    _, term, x = bags.entries(terms, "x")
    at = lookup.entry_places(hashes, term).astype(np.int32)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (at, x)], ["at", "x"])


class Rows:
    def __init__(self, batch: pa.RecordBatch):
        self.n = batch.num_rows
        self.label, self.c = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("label", "c"))
        self.row = np.repeat(np.arange(self.n), bags._lengths(batch["at"]))
        self.at, self.x = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("at", "x"))

    def margins(self, parameters: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.x * parameters[self.at], self.n) + parameters[-1]

    def slopes(self, r: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        sums = np.bincount(self.at, r[self.row] * x, size).astype(float)
        sums[-1] += r.sum()
        return sums


def log_loss(z: np.ndarray, label: np.ndarray) -> np.ndarray:
    signed = np.where(label == 1, z, -z)
    return np.log1p(np.exp(-np.abs(signed))) + np.maximum(-signed, 0.0)


def log_slope(z: np.ndarray, label: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-z)) - label


def squared_loss(z: np.ndarray, label: np.ndarray) -> np.ndarray:
    return (z - label) ** 2 / 2


def squared_slope(z: np.ndarray, label: np.ndarray) -> np.ndarray:
    return z - label


def losses(shared, steps: list[float], loss: Callable) -> Callable:
    """For ``mapInArrow``: the loss of a task's rows after each step from the first along the second of two shared arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(steps))
        for batch in batches:
            rows = Rows(batch)
            w, d = (rows.margins(v) for v in shared.value)
            sums += [float((rows.c * loss(w + t * d, rows.label)).sum()) for t in steps]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(steps), dtype=np.int32)), pa.array(sums)], ["at", "total"])

    return run


def gradients(shared, slope: Callable, curvature: float | None = None) -> Callable:
    """For ``mapInArrow``: the gradient of a task's rows at shared parameters and, with ``curvature``, the bound of the second
    derivatives after it, in chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value)
        sums = np.zeros(size if curvature is None else 2 * size)
        for batch in batches:
            rows = Rows(batch)
            sums[:size] += rows.slopes(rows.c * slope(rows.margins(shared.value), rows.label), rows.x, size)
            if curvature is not None:
                sums[size:] += rows.slopes(rows.c * curvature, rows.x * rows.x, size)
        yield from network.chunks(sums)

    return run
