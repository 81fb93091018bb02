"""Exact Jaccard join of documents on n-grams of words, by skipping with set relations.

* Equal sets are one class; only one of them takes part.
* Index lists: a set's n-grams are ordered from rare to frequent, and only as many of the rarest as two
  similar sets must share one of are listed. Lists are cut into blocks in the order of set size and
  position, and what sizes or positions rule out is skipped.
* Set relations: each list has a leader, the set that shares most list entries with others. A set joins the leader it
  meets most often if they are near enough, and from then on it is known by its difference to the leader. The
  symmetric difference of two sets of a group is that of their differences to the leader, so the answers of
  all of them (which links, how many) follow from what distinguishes them, a few n-grams each. Groups are dealt out by
  pairs of blocks; a task writes down the number of links of each set and its component in the block, not the pairs.
* Only pairs from different groups are listed one by one; a bound from parity bits is checked before their sets
  are fetched and compared.

The frequency order is made from counts over all documents, merged from per-task summaries. Any order
gives exact results; the order only decides how long the lists are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import written
from precis.llm.components import components

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA24BAED4963EE407, 0x9FB21C651E98DF25], dtype=np.uint64)
_TOGETHER = 1 << 18  # bytes of text that are hashed at once
_COUNTED = 4_000_000  # n-grams that a task counts at once
_HEAVY = 1 << 18  # bound of the table of frequent n-grams
_BLOCK = 2048  # entries in a block of an index list
_OUT = 100_000
_EXPANDED = 1_000_000  # pairs that are looked at together
_MEMBERS = 1024  # sets in a block of a group
_COLUMNS = 2048  # n-grams that a block pair multiplies at once
_NEAR = 25  # a set joins a leader if they differ in at most so many hundredths of both sizes together


@dataclass(frozen=True)
class Settings:
    """``n`` words in an n-gram (at most 8); similarity is at least ``percent`` hundredths."""

    n: int = 5
    percent: int = 80


class _Powers:
    """Powers of an odd number modulo 2^64 and their inverses, as long as any group of texts so far."""

    base = 0x9DDFEA08EB382D69

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            one = np.array([1], np.uint64)
            step = np.full(n, self.base, np.uint64), np.full(n, pow(self.base, -1, 2**64), np.uint64)
            self.up, self.down = (np.cumprod(np.concatenate([one, x]), dtype=np.uint64) for x in step)
        return self.up[:n], self.down


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _words(data: np.ndarray, starts: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word in a buffer of texts that begin at ``starts``."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = edge[0] = edge[-1] = True
    blank = _SPACE[data]
    left = np.append(True, blank[:-1]) | edge[:-1]
    right = np.append(blank[1:], True) | edge[1:]
    first, last = np.flatnonzero(~blank & left), np.flatnonzero(~blank & right) + 1
    up, down = powers.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * up, out=sums[1:])
    value = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _FACTORS[6]
    value ^= value >> np.uint64(32)
    value *= _FACTORS[4]
    value ^= value >> np.uint64(29)
    return value, np.searchsorted(starts, first, side="right") - 1


def _grams(values: np.ndarray, width: int) -> np.ndarray:
    total = np.full(len(values) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total += values[k:len(values) - width + 1 + k] * _FACTORS[k]
        total ^= total >> np.uint64(31)
    total *= _FACTORS[3]
    return total ^ (total >> np.uint64(32))


def ngram_sets(column: pa.Array, n: int, powers: _Powers) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its different n-grams.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A shorter text is one
    n-gram, an empty or null one has none. Texts are hashed in groups of about ``_TOGETHER`` bytes.
    """
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _TOGETHER, side="right")) - 1)
        part, starts = data[offsets[at]:offsets[end]], offsets[at:end] - offsets[at]
        if not len(part):
            yield from (np.zeros(0, np.int64) for _ in range(at, end))
            at = end
            continue
        words, owner = _words(part, starts, powers)
        edges = np.searchsorted(owner, np.arange(end - at + 1))
        grams = _grams(words, n) if len(words) >= n else np.zeros(0, np.uint64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = grams[a:b - n + 1] if b - a >= n else _grams(words[a:b], b - a) if b > a else grams[:0]
            own = np.sort(own.view(np.int64))
            yield own if len(own) < 2 else own[np.append(True, own[1:] != own[:-1])]
        at = end


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def parity_bits(grams: np.ndarray) -> bytes:
    """Of about two buckets for each n-gram, whether the number of n-grams in it is odd.

    Where two sets have different bits they have different n-grams, so the number of such bits is a lower
    bound of their symmetric difference. A longer field folds to a shorter one by exclusive or.
    """
    width = 64
    while width < 2 * len(grams):
        width *= 2
    bucket = grams.view(np.uint64) >> np.uint64(17) & np.uint64(width - 1)
    odd = np.bincount(bucket.astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def different_bits(one: bytes, two: bytes) -> int:
    while len(one) != len(two):
        if len(one) < len(two):
            one, two = two, one
        half = len(one) // 2
        one = (int.from_bytes(one[:half]) ^ int.from_bytes(one[half:])).to_bytes(half)
    return (int.from_bytes(one) ^ int.from_bytes(two)).bit_count()


def _bounded(most):
    """The pairs whose parity bits do not show that they differ in more than ``most(n_a, n_b)`` n-grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            apart = np.array([different_bits(x, y) for x, y in zip(
                batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], dtype=np.int64)
            ok = pa.array(apart <= most(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in (0, 1)], names=["a", "b"])

    return run


def _describe(n: int):
    """A row of size, digest and parity bits for each document, and rows of n-grams that are frequent in
    the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size, seen = _Powers(), [], 0, set()
        names = ["doc", "n", "d1", "d2", "bits", "gram", "count"]

        def frequent() -> Iterator[pa.RecordBatch]:
            if held:
                every = np.concatenate(held)
                held.clear()
                every.sort()  # in place: the n-grams of a task are its largest array
                grams = np.unique(every[3:][every[3:] == every[:-3]])
                counts = np.searchsorted(every, grams, side="right") - np.searchsorted(every, grams)
                none = pa.nulls(len(grams), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, none, none, pa.nulls(len(grams), pa.binary()), pa.array(grams), pa.array(counts)],
                    names=names)

        for batch in batches:
            sizes, digests, bits = [], [], []
            for grams in ngram_sets(batch.column(1), n, powers):
                digest = _digest(grams)
                sizes.append(len(grams))
                digests.append(digest)
                bits.append(parity_bits(grams))
                if digest not in seen:
                    seen.add(digest)
                    held.append(grams)
                    size += len(grams)
                    if size >= _COUNTED:
                        yield from frequent()
                        size = 0
                        seen.clear()
            digests = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                 pa.array(bits, pa.binary()), none, none],
                names=names)
        yield from frequent()

    return run


def _arrays(n: int, percent: int, heavy=None):
    """The whole set of each document, or with ``heavy`` (grams and counts) its prefix in list order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        table, counts = heavy.value if heavy is not None else (None, None)
        for batch in batches:
            sizes, made, digests = [], [], []
            for grams in ngram_sets(batch.column(1), n, powers):
                sizes.append(len(grams))
                digests.append(_digest(grams))
                if table is not None and len(grams):
                    length = len(grams) - (percent * len(grams) + 99) // 100 + 1
                    if len(table):
                        at = np.minimum(np.searchsorted(table, grams), len(table) - 1)
                        grams = grams[np.lexsort((grams, np.where(table[at] == grams, counts[at], 0)))]
                    grams = grams[:length]
                made.append(grams)
            offsets = np.cumsum([0] + [len(g) for g in made]).astype(np.int32)
            values = np.concatenate(made) if made else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            digests = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists],
                names=["doc", "n", "d1", "d2", "grams"])

    return run


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries in list order: those of lists with at least two, numbered by block."""
    names = ["gram", "doc", "n", "pos", "block"]
    carry, at, passed = None, 0, False  # the last entry, its index in its list, whether it went on
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(4)]
        if carry is not None:
            columns = [np.append(a, b) for a, b in zip(carry, columns, strict=True)]
        gram = columns[0]
        if not len(gram):
            continue
        edges = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        lengths = np.diff(np.append(edges, len(gram)))
        index = np.arange(len(gram)) - np.repeat(edges, lengths)
        index[:lengths[0]] += at
        keep = np.repeat(lengths > 1, lengths)
        if passed:
            keep[:lengths[0]] = True
        passed_now = bool(keep[-1])
        keep[0] &= not passed
        carry, at, passed = [c[-1:] for c in columns], int(index[-1]), passed_now
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[keep]) for c in columns] + [pa.array(index[keep] // _BLOCK)], names=names)


def _needed(a, b, percent: int):
    """Overlap that sets of these sizes need: 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows, cut where the first ``keys`` columns change. Rows come in the order of the key,
    and no key has more rows than two blocks, which bounds what is carried to the next batch."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        cut = int(_edges(columns[:keys])[-1])
        if cut:
            yield [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
    if held is not None:
        yield held


def _edges(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new key begins."""
    change = np.ones(len(keys[0]), dtype=bool)
    change[1:] = False
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(change)


def _first_of_size(group: np.ndarray, n: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Index of the first row in the group of each row whose size is at least ``least``."""
    span = int(n.max()) + 1
    return np.searchsorted(group * span + n, group * span + least)


def _pairs_out(one: np.ndarray, two: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(one), _OUT):
        a, b = one[at:at + _OUT], two[at:at + _OUT]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _fits(n1, p1, n2, p2, percent: int):
    """Whether sets of these sizes that share the n-gram at these positions can be similar.

    If it is the first n-gram they share, the rest of the smaller one bounds their overlap; a pair that
    shares an earlier one is found in that list.
    """
    return 1 + np.minimum(n1 - 1 - p1, n2 - 1 - p2) >= _needed(n1, n2, percent)


def _open_pairs(percent: int):
    """In each pair of blocks: all pairs of sets that may be similar and whose groups differ.

    Of two sets the smaller one (or the earlier, if equal) must have the n-gram so early that it can
    still reach the overlap; only such entries are partners. A block whose sets are all in one
    group is skipped, and of the others what is too small or listed too late.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, 3):
            edges = _edges(columns[:3])
            lengths = np.diff(np.append(edges, len(columns[0])))
            label = columns[7]
            mixed = np.minimum.reduceat(label, edges) != np.maximum.reduceat(label, edges)
            keep = np.repeat(mixed, lengths)
            gram, one, two, block, doc, n, pos, label = (c[keep] for c in columns)
            if not len(doc):
                continue
            group = np.repeat(np.arange(int(mixed.sum())), lengths[mixed])
            early = np.flatnonzero(pos <= n - _needed(n, n, percent))
            if not len(early):
                continue
            span = int(n.max()) + 1
            low = np.searchsorted(group[early] * span + n[early], group * span + -(-percent * n // 100))
            high = np.searchsorted(early, np.arange(len(doc)))
            count = np.maximum(high - low, 0)
            ends = np.cumsum(count)
            at = 0
            while at < len(doc):
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + _EXPANDED, side="right")))
                y = np.repeat(np.arange(at, stop), count[at:stop])
                offset = np.arange(len(y)) - np.repeat(ends[at:stop] - count[at:stop] - before, count[at:stop])
                x = early[low[y] + offset]
                ok = (label[x] != label[y]) & (doc[x] != doc[y]) & ((block[x] != block[y]) | (one[y] == two[y]))
                x, y = x[ok], y[ok]
                ok = _fits(n[x], pos[x], n[y], pos[y], percent)
                yield from _pairs_out(doc[x[ok]], doc[y[ok]])
                at = stop

    return run


def _group_links(percent: int, listed: bool):
    """In a pair of blocks of a group: which sets are similar, from their differences to the leader.

    Rows ``doc, top, n_links``: the smallest set of its component and the number of its links in this pair of blocks; with
    ``listed`` the links themselves, as rows ``a, b``.
    """
    def run(key: tuple, table: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        table = table.sort_by("doc").combine_chunks()
        doc, n, block = (table.column(x).to_numpy() for x in ("doc", "n", "block"))
        lists = table.column("grams").combine_chunks()
        size = lists.value_lengths().to_numpy()
        names, number, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        # What only one of them differs in is in no common part.
        column = np.cumsum(count > 1) - 1
        often = count[number] > 1
        row, column = np.repeat(np.arange(len(doc)), size)[often], column[number[often]]
        one = np.arange(len(doc)) if same else np.flatnonzero(block == key[1].as_py())
        two = one if same else np.flatnonzero(block == key[2].as_py())
        common = np.zeros((len(one), len(two)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int((count > 1).sum()), _COLUMNS):
            low, high = np.searchsorted(column, [start, start + _COLUMNS])
            has = np.zeros((len(doc), _COLUMNS), dtype=np.float32)
            has[row[low:high], column[low:high] - start] = 1
            common += has[one] @ has[two].T
        both = n[one][:, None] + n[two]
        twice = both - (size[one][:, None] + size[two] - 2 * common.astype(np.int64))  # the overlap, twice
        linked = 100 * twice >= percent * (2 * both - twice)
        if same:
            np.fill_diagonal(linked, False)
        if listed:
            a, b = np.nonzero(np.triu(linked) if same else linked)
            ends = doc[one[a]], doc[two[b]]
            return pa.table({"a": np.minimum(*ends), "b": np.maximum(*ends)})
        links = np.zeros(len(doc), dtype=np.int64)
        links[one] += linked.sum(axis=1)
        if not same:
            links[two] += linked.sum(axis=0)
        top = np.arange(len(doc))
        while True:
            new = top.copy()
            new[one] = np.minimum(new[one], np.where(linked, new[two], len(doc)).min(axis=1, initial=len(doc)))
            new[two] = np.minimum(new[two], np.where(linked, new[one][:, None], len(doc)).min(axis=0, initial=len(doc)))
            if np.array_equal(new, top):
                break
            top = new
        some = links > 0
        return pa.table({"doc": doc[some], "top": doc[top[some]], "n_links": links[some]})

    return run


class _Join:
    """The tables of a join: ``rows`` (``doc, n, d1, d2``), ``classes`` of equal sets, and what links them."""

    def __init__(self, docs: DataFrame, s: Settings, doc_id: str, text: str):
        self.s = s
        self.source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
        described = self.source.mapInArrow(_describe(s.n), "doc long, n long, d1 long, d2 long, bits binary, gram long, count long")
        described = written(described, "set-digests")
        self.rows = described.filter("n is not null").select("doc", "n", "d1", "d2")
        classes = described.filter("n > 0 and doc is not null").groupBy("d1", "d2").agg(
            F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
        self.classes = written(classes.withColumn("doc", F.monotonically_increasing_id()), "set-classes")
        self.lists = self._index(described)
        self.members = self._groups()
        self.across = self._across()

    def _arrays_of(self, wanted: DataFrame, heavy=None) -> DataFrame:
        """``doc, n, grams`` of classes, each once; ``doc`` is the number of the class from here on."""
        kind = "rep long, n long, d1 long, d2 long, grams array<long>"
        keys = ["rep", "d1", "d2"]
        texts = self.source.withColumnRenamed("doc", "rep").join(wanted.select("rep").distinct(), "rep", "left_semi")
        made = texts.mapInArrow(_renamed(_arrays(self.s.n, self.s.percent, heavy)), kind)
        return made.join(wanted.select("doc", *keys), keys).dropDuplicates(keys).select("doc", "n", "grams")

    def _index(self, described: DataFrame) -> DataFrame:
        counts = described.filter("n is null").groupBy("gram").agg(F.sum("count").alias("count")).filter("count >= 8")
        heavy = counts.orderBy(F.col("count").desc(), "gram").limit(_HEAVY).toPandas().sort_values("gram")
        shared = described.sparkSession.sparkContext.broadcast((heavy["gram"].to_numpy(np.int64), heavy["count"].to_numpy(np.int64)))
        entries = self._arrays_of(self.classes, shared).select("doc", "n", F.posexplode("grams").alias("pos", "gram"))
        entries = entries.select("gram", "doc", "n", F.col("pos").cast("long").alias("pos"))
        lists = entries.repartition("gram").sortWithinPartitions("gram", "n", "pos", "doc")
        return written(lists.mapInArrow(_shared_lists, "gram long, doc long, n long, pos long, block long"), "index-lists")

    def _plausible(self, pairs: DataFrame, most) -> DataFrame:
        one, two = (self.classes.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
        met = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
        return met.mapInArrow(_bounded(most), "a long, b long")

    def _with_sets(self, pairs: DataFrame, name: str) -> DataFrame:
        """``a, b, na, nb, ga, gb``: the pairs with their whole sets."""
        ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
        sets = written(self._arrays_of(self.classes.join(ids, "doc", "left_semi")), name)
        one, two = (sets.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("grams").alias(f"g{x}")) for x in "ab")
        return pairs.join(one, "a").join(two, "b")

    def _groups(self) -> DataFrame:
        """``leader, doc, n, grams``: of each member its difference to the leader, which is a member with none."""
        sizes = self.lists.groupBy("gram").agg(F.count("*").alias("length"))
        scores = self.lists.join(sizes, "gram").groupBy("doc").agg(F.sum("length").alias("score"))
        leaders = self.lists.select("gram", "doc").join(scores, "doc").groupBy("gram").agg(
            F.max(F.struct("score", (-F.col("doc")).alias("minus"))).alias("top"))
        met = self.lists.select("gram", "doc").join(leaders, "gram").groupBy("doc", "top").agg(F.count("*").alias("times"))
        best = met.groupBy("doc").agg(F.max_by(-F.col("top.minus"), F.struct("times", "top")).alias("b"))
        best = written(best.filter("doc <> b").select(F.col("doc").alias("a"), "b"), "leaders")
        most = lambda na, nb: _NEAR * (na + nb) // 100
        near = written(self._plausible(best, most), "near-leaders")
        apart = F.concat(F.array_except("ga", "gb"), F.array_except("gb", "ga"))
        differing = self._with_sets(near, "led-sets").select(F.col("b").alias("leader"), F.col("a").alias("doc"), F.col("na").alias("n"), "nb",
                                                             apart.alias("grams"))
        near_enough = 100 * F.size("grams") <= _NEAR * (F.col("n") + F.col("nb"))
        differing = written(differing.filter(near_enough), "differences")
        own = differing.select("leader", F.col("leader").alias("doc"), F.col("nb").alias("n")).distinct()
        # A leader that has joined another one stays there.
        own = own.join(differing.select("doc"), "doc", "left_anti").select("leader", "doc", "n")
        members = differing.select("leader", "doc", "n", "grams")
        return written(members.unionByName(own.withColumn("grams", F.array().cast("array<long>"))), "members")

    def within(self, listed: bool = False) -> DataFrame:
        """The answers of all groups; see :func:`_group_links`."""
        blocks = self.members.groupBy("leader").agg(F.ceil(F.count("*") / _MEMBERS).alias("blocks"))
        dealt = self.members.join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.select("leader", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                             "block", "doc", "n", "grams")
        kind = "a long, b long" if listed else "doc long, top long, n_links long"
        return dealt.groupBy("leader", "one", "two").applyInArrow(_group_links(self.s.percent, listed), kind)

    def _across(self) -> DataFrame:
        """Links ``a, b`` of sets of different groups; a set without a leader is a group."""
        labels = self.members.select("doc", F.col("leader").alias("label"))
        labelled = self.lists.join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        long = self.lists.groupBy("gram").agg(F.max("block").alias("last")).filter("last > 0")
        placed = labelled.join(long, "gram", "left").withColumn("last", F.coalesce("last", F.lit(0)))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        placed = placed.select("gram", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                               "block", "doc", "n", "pos", "label")
        placed = placed.repartition("gram", "one", "two").sortWithinPartitions("gram", "one", "two", "n", "pos", "doc")
        percent = self.s.percent
        pairs = placed.mapInArrow(_open_pairs(percent), "a long, b long").distinct()
        self.listed = written(pairs, "open-pairs")
        most = lambda na, nb: na + nb - 2 * _needed(na, nb, percent)
        pairs = written(self._plausible(self.listed, most), "plausible-pairs")
        common = F.size(F.array_intersect("ga", "gb"))
        found = self._with_sets(pairs, "sets").select("a", "b", "na", "nb", common.alias("k"))
        return written(found.filter(100 * F.col("k") >= percent * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b"), "links")

    def named(self, pairs: DataFrame) -> DataFrame:
        """Pairs of classes by their smallest documents, the smaller one first."""
        one, two = (self.classes.select(F.col("doc").alias(x), F.col("rep").alias(f"rep{x}")) for x in "ab")
        both = pairs.join(one, "a").join(two, "b")
        return both.select(F.least("repa", "repb").alias("a"), F.greatest("repa", "repb").alias("b"))

    def found(self) -> DataFrame:
        """``doc, n, component, rep, n_links`` of every row; rows without a set or an id are their own."""
        answers = written(self.within(), "group-answers")
        joined = answers.select(F.col("doc").alias("a"), F.col("top").alias("b")).union(self.across)
        final = components(self.named(joined)).withColumnsRenamed({"node": "rep"})
        ends = answers.select("doc", "n_links")
        for end in "ab":
            ends = ends.union(self.across.select(F.col(end).alias("doc"), F.lit(1).cast("long")))
        ends = ends.groupBy("doc").agg(F.sum("n_links").alias("n_links"))
        known = self.classes.join(final, "rep", "left").join(ends, "doc", "left").select(
            "d1", "d2", "rep", F.coalesce("component", "rep").alias("component"), "n_links")
        joined = self.rows.join(known, ["d1", "d2"], "left")
        own = lambda name: F.when(F.col("n") > 0, F.when(F.col("doc").isNotNull(), F.col(name))).otherwise(F.col("doc"))
        return joined.select("doc", "n", own("component").alias("component"), own("rep").alias("rep"),
                             F.when(F.col("doc").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def _renamed(function):
    """The same batches with ``rep`` as the name of the first column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in function(batches):
            yield batch.rename_columns(["rep", *batch.schema.names[1:]])

    return run


def similar_sets(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, n, component, rep, n_links`` of every row: set size, smallest document that links lead to, the smallest
    document with an equal set, and the number of different sets that are linked to this one.

    A null or blank text has no set: size 0, linked with nothing. A row with a null id has a null
    component and links nothing. Rows that share an id are one document, linked if any of its texts is. Texts of any length are
    hashed whole; a set has to fit into a task. No rows give no rows. Other columns are not looked at.
    """
    return _Join(docs, settings, doc_id, text).found()


def linked_sets(
    docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Every link, written out, and :func:`similar_sets`.

    The first table has a row ``a, b`` (``a < b``) for each two classes of equal sets that are similar,
    named by their smallest documents. Within a family of copies it grows with the square of their number.
    """
    join = _Join(docs, settings, doc_id, text)
    return join.named(join.within(listed=True).union(join.across)), join.found()
