"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes are sorted only as deep as the threshold (50 bytes), digit by digit from the most significant
one, and a group that holds the suffixes of a single document is dropped at once. The groups that are
left at full depth are exactly the repeated windows.

* The first digit must bring equal windows together without moving every suffix: it is the window's
  minimizer, the 16-byte string in it with the smallest hash. Neighbouring windows share it, so only
  about one suffix in eighteen is shuffled, as hash and document, and all whose minimizer occurs in one
  document only end there.
* The windows of the remaining buckets are then ordered by their bytes, eight at a time.
* A bucket that is too large for one task is split by whole windows and dealt out once more.

Equal slices within a task are settled there, so a passage that a third of all documents contain is sent
once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.llm.common import map_arrow, written

_GRAM = 16
_CHUNK = 1 << 17
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_LOW = np.uint64(_CHUNK * 2 - 1)
_SEEN = 300_000  # slices that a task remembers at once
_ROWS = 40_000  # rows of whole buckets that are sorted together
_BUCKET = 20_000  # different slices of one bucket that a task sorts itself


def window_runs(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of neighbouring windows with the same minimizer, for texts that lie in one buffer.

    Yields arrays: bucket (hash of the minimizer), text number, first window (position in the buffer),
    number of windows. ``starts`` and ``stops`` bound the texts, in ascending order.
    """
    filled = np.flatnonzero(stops > starts)
    if not len(filled):
        return
    starts, stops = starts[filled], stops[filled]
    span = depth - _GRAM + 1
    lowest, highest = int(starts[0]), int(stops[-1])
    for at in range(lowest, highest - depth + 1, _CHUNK):
        end = min(at + _CHUNK, highest - depth + 1)  # windows that start in [at, end)
        part = data[at:end + depth - 1]
        n = len(part)
        words = np.ndarray((n - 7,), dtype="<u8", buffer=part, strides=(1,))
        value = words[:n - _GRAM + 1] * _C1
        value ^= value >> np.uint64(29)
        value += words[8:8 + n - _GRAM + 1] * _C2
        value *= _C3
        value ^= value >> np.uint64(32)
        least = (value & ~_LOW) | np.arange(len(value), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
        place = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place))
        anchor = place[first]
        text = np.searchsorted(starts, anchor + at, side="right") - 1
        first = np.maximum(first + at, starts[text])
        last = np.minimum(last + at, stops[text] - depth + 1)
        keep = last > first
        yield value[anchor[keep]].view(np.int64), filled[text[keep]], first[keep], (last - first)[keep]


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and stops of a text column, without a copy; a null text is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


def _first_digit(depth: int):
    """Rows (dealt, bucket, doc): one for each bucket of a document.

    A bucket with two documents in the same batch is settled: its rows are dealt out evenly, and one
    more row tells the other tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, stops = _buffer(batch.column(1))
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            found = [(b, docs[t]) for b, t, _, _ in window_runs(data, starts, stops, depth)]
            if not found:
                continue
            bucket, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, bucket))
            bucket, doc = bucket[order], doc[order]
            new_bucket = np.diff(bucket, prepend=bucket[0] - 1) != 0
            fresh = new_bucket | (np.diff(doc, prepend=doc[0] - 1) != 0)
            bucket, doc, new_bucket = bucket[fresh], doc[fresh], new_bucket[fresh]
            group = np.cumsum(new_bucket) - 1
            several = (np.bincount(group) > 1)[group]
            spread = bucket + (doc.astype(np.uint64) * _C1 | np.uint64(1)).view(np.int64)
            tell = np.flatnonzero(new_bucket & several)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.where(several, spread, bucket), bucket[tell]])),
                pa.array(np.concatenate([bucket, bucket[tell]])),
                pa.array(np.concatenate([doc, doc[tell]])),
            ], names=["dealt", "bucket", "doc"])

    return run


def _shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of (dealt, doc): those of buckets with two documents, and settled rows."""
    last: tuple[int, int, bool] | None = None  # bucket, document, whether it has been passed on
    for batch in batches:
        dealt, bucket, doc = (batch.column(i).to_numpy() for i in range(3))
        settled = dealt != bucket
        open_bucket, open_doc = bucket[~settled], doc[~settled]
        passed = np.zeros(len(open_bucket), dtype=bool)
        if last is not None:
            open_bucket, open_doc = np.append(last[0], open_bucket), np.append(last[1], open_doc)
            passed = np.append(last[2], passed)
        if len(open_bucket):
            group = np.cumsum(np.diff(open_bucket, prepend=open_bucket[0]) != 0)
            edges = np.flatnonzero(np.diff(group, prepend=-1))
            stops = np.append(edges[1:], len(group)) - 1
            several = open_doc[edges] != open_doc[stops]
            several[0] |= last is not None and last[2]
            keep = several[group]
            last = int(open_bucket[-1]), int(open_doc[-1]), bool(keep[-1])
            out_bucket, out_doc = open_bucket[keep & ~passed], open_doc[keep & ~passed]
        else:
            out_bucket, out_doc = open_bucket, open_doc
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([out_doc, doc[settled]])), pa.array(np.concatenate([out_bucket, bucket[settled]]))],
            names=["doc", "bucket"])


_SLICES = "dealt long, slice binary, doc long, rid long, start int, stop int"


class _Out:
    """Rows of the ``_SLICES`` layout; without a slice they are settled spans to be removed."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, dealt, slice_, doc, rid, start, stop) -> None:
        self.rows.append((dealt, slice_, doc, rid, start, stop))

    def settle(self, doc, rid, start, stop) -> None:
        """A span to be removed; it is joined with the row before if it continues that one's span."""
        if self.rows:
            dealt, piece, last_doc, last_rid, first, end = self.rows[-1]
            if piece is None and last_doc == doc and last_rid == rid and first <= start <= end:
                self.rows[-1] = (dealt, None, doc, rid, first, max(stop, end))
                return
        self.rows.append((rid ^ start, None, doc, rid, start, stop))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = list(zip(*self.rows, strict=True)) or [()] * 6
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          names=["dealt", "slice", "doc", "rid", "start", "stop"])


def _cut_slices(depth: int):
    """For each run of a shared bucket the bytes of its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        out = _Out()
        for batch in batches:
            data, starts, stops = _buffer(batch.column(1))
            docs, rids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            raw = data.tobytes()
            owner = np.repeat(np.arange(len(docs)), np.diff(offsets))
            wanted = np.unique(_pair(values[offsets[0]:offsets[-1]], owner))
            for bucket, text, first, count in window_runs(data, starts, stops, depth):
                pairs = _pair(bucket, text)
                hit = wanted[np.minimum(np.searchsorted(wanted, pairs), len(wanted) - 1)] == pairs
                for b, t, at, n in zip(bucket[hit].tolist(), text[hit].tolist(), first[hit].tolist(), count[hit].tolist(), strict=True):
                    piece = raw[at:at + n + depth - 1]
                    doc, start = docs[t], at - int(starts[t])
                    earlier = seen.get(piece)
                    if earlier is not None and earlier < doc:
                        out.settle(doc, rids[t], start, start + len(piece))
                    else:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen[piece] = doc
                        out.add(b, piece, doc, rids[t], start, start + len(piece))
                if len(out.rows) > _ROWS:
                    yield out.batch()
        yield out.batch()

    return run


def _pair(bucket: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Bucket and text in one number; a chance collision only costs a look at one more slice."""
    return bucket.view(np.uint64) * _C1 ^ (text.astype(np.uint64) * _C3)


def smallest_docs(slices: list[bytes], buckets: np.ndarray, docs: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each window of each slice the smallest document of its equal windows in the same bucket.

    Most-significant-digit radix passes over all buckets at once. A group of one window is dropped after
    the digit that singles it out.
    """
    buffer = np.frombuffer(b"".join(slices) + bytes(8), dtype=np.uint8)
    n_windows = np.array([len(s) for s in slices]) - depth + 1
    base = np.cumsum([0] + [len(s) for s in slices[:-1]])
    owner = np.repeat(np.arange(len(slices)), n_windows)
    first = np.cumsum(n_windows) - n_windows
    place = np.arange(len(owner)) - first[owner] + base[owner]
    words = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    least = docs[owner]
    active, group = np.arange(len(owner)), buckets[owner]
    for digit in [*range(0, depth - 8, 8), depth - 8]:
        key = words[place[active] + digit]
        order = np.lexsort((key, group))
        active, key, group = active[order], key[order], group[order]
        change = np.ones(len(active), dtype=bool)
        change[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(change) - 1
        shared = (np.bincount(group) > 1)[group] if len(group) else change
        active, group = active[shared], group[shared]
        if not len(active):
            break
    if len(active):
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        low = np.minimum.reduceat(least[active], edges)
        least[active] = np.repeat(low, np.diff(np.append(edges, len(active))))
    return np.split(least, first[1:])


def _sort_buckets(depth: int, again: bool = False):
    """From rows in the order of (dealt, doc): the spans to be removed; rows of too large buckets go on.

    In the second pass (``again``) a bucket is one window, so none is too large.
    """
    def settle(rows: list[tuple], carried: int, out: _Out) -> list[tuple]:
        """Sort whole buckets (or, with ``carried`` slices of an earlier part, the next part of one)."""
        distinct: dict[tuple[int, bytes], int] = {}
        docs: list[int] = []
        which = []
        for dealt, piece, doc, *_ in rows:
            index = distinct.setdefault((dealt, piece), len(distinct))
            if index == len(docs):
                docs.append(doc)
            which.append(index)
        keys = list(distinct)
        buckets = np.unique(np.array([k[0] for k in keys]), return_inverse=True)[1]
        crowded = (np.bincount(buckets) > 1)[buckets]
        least: list = [None] * len(keys)
        busy = np.flatnonzero(crowded)
        if len(busy):
            low = smallest_docs([keys[i][1] for i in busy], buckets[busy], np.array(docs)[busy], depth)
            for i, values in zip(busy.tolist(), low, strict=True):
                lowest = int(values.min())
                least[i] = lowest if lowest == values.max() else values
        for index, (_, piece, doc, rid, start, _) in zip(which[carried:], rows[carried:], strict=True):
            low = docs[index] if least[index] is None else least[index]
            if isinstance(low, int):
                if low < doc:
                    out.add(None, None, doc, rid, start, start + len(piece))
                continue
            mask = np.diff(np.concatenate([[0], low < doc, [0]]).astype(np.int8))
            for a, b in zip(np.flatnonzero(mask == 1).tolist(), np.flatnonzero(mask == -1).tolist(), strict=True):
                out.add(None, None, doc, rid, start + a, start + b - 1 + depth)
        last = rows[-1][0] if rows else None
        return [(last, k[1], d, 0, 0, 0) for k, d in zip(keys, docs, strict=True) if k[0] == last]

    def windows(rows: list[tuple], out: _Out, seen: dict[bytes, int]) -> None:
        for _, piece, doc, rid, start, _ in rows:
            for at in range(len(piece) - depth + 1):
                window = piece[at:at + depth]
                earlier = seen.get(window)
                if earlier is not None and earlier < doc:
                    out.add(None, None, doc, rid, start + at, start + at + depth)
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen[window] = doc
                dealt = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                out.add(dealt, window, doc, rid, start + at, start + at + depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, carried = _Out(), [], 0
        large, seen = None, {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[1] is None:
                    out.add(None, *row[1:])
                    continue
                if row[0] == large:
                    windows([row], out, seen)
                    continue
                if len(rows) - carried >= _ROWS and row[0] != rows[-1][0]:
                    settle(rows, carried, out)
                    rows, carried = [], 0
                elif len(rows) - carried >= 2 * _ROWS:
                    rows = settle(rows, carried, out)
                    carried = len(rows)
                    if carried > _BUCKET and not again:
                        # Windows seen so far go on as sources; the rest of the bucket, whatever the
                        # length of its slices, follows them.
                        large, seen = row[0], {}
                        sources = [(k, piece, doc, None, 0, 0) for k, piece, doc, *_ in rows]
                        windows(sources, out, seen)
                        rows, carried = [], 0
                        windows([row], out, seen)
                        continue
                rows.append(row)
            if len(out.rows) > _ROWS:
                yield out.batch()
        if rows:
            settle(rows, carried, out)
        yield out.batch()

    return run


def repeated_spans(docs: DataFrame, depth: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans ``doc, rid, start, stop`` of bytes to remove (``rid`` is a hash of the text)."""
    if depth < _GRAM + 8:
        raise ValueError(f"depth must be at least {_GRAM + 8}")
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    source = source.filter(F.col("doc").isNotNull() & (F.octet_length("text") >= depth))
    suffixes = source.mapInArrow(_first_digit(depth), "dealt long, bucket long, doc long")
    shared = suffixes.repartition("dealt").sortWithinPartitions("dealt", "doc")
    shared = written(shared.mapInArrow(_shared_buckets, "doc long, bucket long"), "shared-buckets")
    # A text that a smaller document has too is repeated as a whole; only one of them has to be sorted.
    digests = source.select("doc", F.xxhash64("text").alias("rid"), F.octet_length("text").alias("stop"),
                            F.unhex(F.sha2("text", 256)).alias("digest"))
    digests = written(digests, "digests")
    first_of = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = written(digests.join(first_of, "digest").filter("doc > first").select("doc", "rid", "stop"), "copies")
    lists = shared.groupBy("doc").agg(F.collect_set("bucket").alias("buckets"))
    # Rows that share an id with a copy but have another text stay.
    other = digests.join(copies.select("doc", "rid"), ["doc", "rid"], "left_anti").select("doc").distinct()
    lists = lists.join(other, "doc", "left_semi")
    keyed = source.withColumn("rid", F.xxhash64("text")).join(lists, "doc").select("doc", "text", "rid", "buckets")
    slices = keyed.mapInArrow(_cut_slices(depth), _SLICES)
    ordered = slices.repartition("dealt").sortWithinPartitions("dealt", "doc")
    first = written(ordered.mapInArrow(_sort_buckets(depth), _SLICES), "bucket-spans")
    again = first.filter(F.col("slice").isNotNull()).repartition("dealt").sortWithinPartitions("dealt", "doc")
    spans = first.filter(F.col("slice").isNull()).unionByName(again.mapInArrow(_sort_buckets(depth, again=True), _SLICES))
    spans = spans.filter(F.col("rid").isNotNull()).select("doc", "rid", "start", "stop")
    return spans.unionByName(copies.select("doc", "rid", F.lit(0).alias("start"), F.col("stop").cast("int").alias("stop")))


FIELDS = {
    "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(),
    "kept_sha256": T.StringType(), "kept": T.BinaryType(), "kept_text": T.StringType(),
}


def remove_repeats(docs: DataFrame, keep: tuple[str, ...], outputs: tuple[str, ...] = tuple(FIELDS), depth: int = 50,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every byte that a string of ``depth`` bytes covers which also starts in a document with a
    smaller id. Strings are judged on the input; overlapping ones all count.

    Returns ``outputs`` of every document beside the columns in ``keep``: sizes in bytes, the number of
    maximal removed runs, the remaining bytes, their sha256, and the remaining text, without what is left of
    a character that a cut goes through. A null text counts as empty. Documents
    shorter than ``depth`` lose nothing, nor do rows with a null id, which are no source either. Rows
    that share an id are one document for the comparison; each keeps its own text.
    """
    spans = repeated_spans(docs, depth, doc_id, text)
    spans = spans.groupBy("doc", "rid").agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    spans = spans.withColumnsRenamed({"doc": "_doc", "rid": "_rid"})
    columns = list(dict.fromkeys([doc_id, text, *keep]))
    plain = docs.select(*columns).withColumn("_key", F.xxhash64(text))
    joined = plain.join(spans, (plain[doc_id].cast("long") == F.col("_doc")) & (F.col("_key") == F.col("_rid")), "left")

    def compute():
        def one(value: str | None, spans: list[dict] | None) -> tuple:
            data = (value or "").encode()
            if not spans:
                return len(data), 0, 0, hashlib.sha256(data).hexdigest(), data, value or ""
            pairs = sorted((s["start"], s["stop"]) for s in spans)
            kept, done, runs = [], 0, 0
            for start, stop in pairs:
                if start > done or not runs:
                    runs += 1
                if start > done:
                    kept.append(data[done:start])
                done = max(done, stop)
            kept.append(data[done:])
            rest = b"".join(kept)
            text = "".join(part.decode("utf-8", "ignore") for part in kept)
            return len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest, text

        wanted = [list(FIELDS).index(name) for name in outputs]

        def run(columns):
            made = [one(t.as_py(), s.as_py()) for t, s in zip(*columns, strict=True)]
            return [[row[i] for row in made] for i in wanted]

        return run

    fields = [T.StructField(name, FIELDS[name]) for name in outputs]
    return map_arrow(joined, [F.col(text).alias("_text"), F.col("_spans"), *keep], fields, compute, inputs=2)
