"""Byte-level BPE encoding and decoding with a rank queue.

The pairs of a pre-token wait in buckets, one for each merge rank, that hold positions of a linked
list of symbols. A bitmap in two levels says which buckets are filled; the next rank is found by
find-first-set from the top level down, so a pre-token of n bytes takes O(n log n) steps however long
it is. Entries whose pair has changed meanwhile are stale and skipped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from precis.llm.common import map_arrow

_CACHED_PIECES = 300_000
_CACHED_CHARS = 64
_MERGED_TOGETHER = 20_000
_HELD_CHARS = 4_000_000
# Bits in a word of the bitmap (as a shift and a mask); the top level is one integer.
_WORD, _IN_WORD = 8, 255


def ascii_pattern(pattern: str) -> str | None:
    """What ``pattern`` means on ASCII text, for the faster matcher; None if it uses other classes."""
    parts, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part.startswith(r"\p"):
            span = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}.get(part)
            if span is None:
                return None
            part = span if inside else f"[{span}]"
        elif part in "[]":
            inside = part == "["
        elif part == r"\P":
            return None
        parts.append(part)
    return "".join(parts)


class ByteBpe:
    """Encoder and decoder for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.split_any = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        self.split_ascii = re.compile(plain, re.ASCII).findall if plain else self.split_any
        self.longest = max(map(len, ranks), default=0)
        size = max(ranks.values(), default=0) + 1
        self.bytes_of = [b""] * size
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.decimal = [str(i) for i in range(size)]
        none = size
        self.pair_rank = np.full(65536, none, dtype=np.int32)
        for piece, rank in ranks.items():
            if len(piece) == 2:
                self.pair_rank[piece[0] << 8 | piece[1]] = rank
        self.known: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        return self.split_ascii(text) if text.isascii() else self.split_any(text)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each pre-token: always the lowest rank, and of equal ones the leftmost, is merged.

        All pieces lie in one linked list with a gap between them, so that one queue serves them all:
        pairs of different pieces never touch, and the order within a piece is that of its own queue.
        ``buckets`` has the positions of each rank. ``words`` and ``top`` are the levels of the
        bitmap: a bit for each filled bucket, and a bit for each word that is not zero.
        """
        rank_of, longest, none = self.ranks.get, self.longest, len(self.bytes_of)
        data = b"\n".join(pieces) + b"\n"
        n = len(data)
        starts = np.cumsum([0] + [len(p) + 1 for p in pieces])
        gaps = starts[1:] - 1
        gap = bytearray(n + 1)
        for position in gaps.tolist():
            gap[position] = 1
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.int32)
        ranks = np.full(n, none, dtype=np.int32)
        ranks[:-1] = self.pair_rank[raw[:-1] << 8 | raw[1:]]
        ranks[gaps] = none
        ranks[np.maximum(gaps - 1, 0)] = none
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), ranks.tolist()

        order = np.argsort(ranks, kind="stable")
        order = order[: np.count_nonzero(ranks != none)]
        first = np.flatnonzero(np.diff(ranks[order], prepend=-1))
        buckets = dict(zip(ranks[order[first]].tolist(), map(np.ndarray.tolist, np.split(order, first[1:]))))
        words: dict[int, int] = {}
        for rank in buckets if len(order) else ():
            words[rank >> _WORD] = words.get(rank >> _WORD, 0) | 1 << (rank & _IN_WORD)
        top = sum(1 << word for word in words)

        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word << _WORD | (bits & -bits).bit_length() - 1
            words[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            positions = buckets.pop(rank)
            positions.sort()
            for done, left in enumerate(positions, 1):
                if pair[left] != rank:
                    continue
                right = after[left]
                after[left] = end = after[right]
                pair[right] = pair[left] = none
                lower = False
                if not gap[end]:
                    before[end] = left
                    stop = after[end]
                    if stop - left <= longest and (found := rank_of(data[left:stop])) is not None:
                        pair[left] = found
                        lower = found < rank
                        if found in buckets:
                            buckets[found].append(left)
                        else:
                            buckets[found] = [left]
                            words[word] = words.get(word := found >> _WORD, 0) | 1 << (found & _IN_WORD)
                            top |= 1 << word
                previous = before[left]
                if previous >= 0 and not gap[previous]:
                    pair[previous] = none
                    if end - previous <= longest and (found := rank_of(data[previous:end])) is not None:
                        pair[previous] = found
                        lower = lower or found < rank
                        if found in buckets:
                            buckets[found].append(previous)
                        else:
                            buckets[found] = [previous]
                            words[word] = words.get(word := found >> _WORD, 0) | 1 << (found & _IN_WORD)
                            top |= 1 << word
                if lower and done < len(positions):
                    # A lower rank came up: it goes first, the rest of this bucket waits.
                    buckets[rank] = positions[done:] + buckets.get(rank, [])
                    words[word] = words.get(word := rank >> _WORD, 0) | 1 << (rank & _IN_WORD)
                    top |= 1 << word
                    break
        merged = []
        for start, stop in zip(starts.tolist(), gaps.tolist()):
            ids = []
            while start < stop:
                end = after[start]
                ids.append(rank_of(data[start:end]))
                start = end
            merged.append(tuple(ids))
        return merged

    def encode_batch(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text; the pre-tokens that are new in a group of texts are merged together."""
        waiting: list[list[str]] = []
        new: dict[str, None] = {}
        size = 0
        for text in texts:
            pieces = self.split(text)
            waiting.append(pieces)
            new.update(dict.fromkeys(set(pieces).difference(self.known)))
            size += len(text)
            if len(new) >= _MERGED_TOGETHER or size >= _HELD_CHARS:
                yield from self._flush(waiting, new)
                waiting, new, size = [], {}, 0
        yield from self._flush(waiting, new)

    def _flush(self, waiting: list[list[str]], new: dict[str, None]) -> Iterator[list[int]]:
        fresh: dict[str, tuple[int, ...]] = {}
        unmerged = []
        for piece in new:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                unmerged.append((piece, raw))
            else:
                fresh[piece] = (whole,)
        for at in range(0, len(unmerged), _MERGED_TOGETHER):
            part = unmerged[at:at + _MERGED_TOGETHER]
            fresh.update(zip((p for p, _ in part), self.merge([raw for _, raw in part])))
        known = self.known.get
        for pieces in waiting:
            yield [i for piece in pieces for i in (known(piece) or fresh[piece])]
        if len(self.known) + len(fresh) > _CACHED_PIECES:
            self.known.clear()
        self.known.update((p, ids) for p, ids in fresh.items() if len(p) <= _CACHED_CHARS)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


_CODECS: dict[tuple[bytes, str], ByteBpe] = {}


def _codec(lines: bytes, pattern: str) -> ByteBpe:
    """The codec of a Python worker: built once, its known pre-tokens serve later tasks as well."""
    key = hashlib.sha256(lines).digest(), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteBpe(parse_ranks(lines), pattern)
    return _CODECS[key]


_OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_sha256": T.StringType(),
    "decoded": T.BinaryType(), "decoded_sha256": T.StringType(),
}


def encode_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    outputs: tuple[str, ...] = ("ids", "n_tokens"),
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Encode every whole text and decode it again.

    ``path`` is the rank file, read once by the driver (it is a vocabulary, so its size is bounded) and
    sent along with the tasks. ``outputs`` picks from ids, n_tokens, ids_sha256 (of the decimal ids
    joined by a space), decoded and decoded_sha256 (of the bytes the ids stand for). The columns in
    ``keep`` stay; one of them that has the name of an output gives way to it.

    A null text counts as empty: no ids, the digest of nothing. Repeated rows are each encoded, an
    empty table gives an empty table, and very long texts need memory in proportion to one text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def compute():
        codec = _codec(shared.value, pattern)

        def sha(data: bytes) -> str:
            return hashlib.sha256(data).hexdigest()

        def one(ids: list[int]) -> tuple:
            row = []
            for name in outputs:
                if name == "ids":
                    row.append(ids)
                elif name == "n_tokens":
                    row.append(len(ids))
                elif name == "ids_sha256":
                    row.append(sha(" ".join(map(codec.decimal.__getitem__, ids)).encode()))
                else:
                    decoded = codec.decode(ids)
                    row.append(decoded if name == "decoded" else sha(decoded))
            return tuple(row)

        def run(columns):
            texts = (value.as_py() or "" for value in columns[0])
            return list(zip(*map(one, codec.encode_batch(texts)), strict=True))

        return run

    fields = [T.StructField(name, _OUTPUTS[name]) for name in outputs]
    return map_arrow(docs, [text, *keep], fields, compute, inputs=1)
