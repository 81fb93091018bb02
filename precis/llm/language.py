"""Language identification with bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: a slot holds one bit for every language, so a single
look-up of an n-gram returns the mask of all languages that contain it. A text's n-grams are looked up,
the bits are counted per language, and each count is corrected for the share of foreign n-grams that the
language's filter lets through by chance. The language with the highest corrected share wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.llm.common import map_arrow, written

UNDECIDED = "und"
_WORD_BITS = 62  # languages in one mask word
_PIECE = 1 << 20  # code points looked up at once


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the rows of one language that the filters are learned from (in expectation:
    rows are drawn by a hash). ``share``: an n-gram belongs to a language if its document rate there is
    at least this share of its highest rate anywhere, and ``least`` documents have it. ``slots`` is a
    power of two and bounds the filter; ``hashes`` slots are set for an n-gram."""

    n: int = 3
    fit_rows: int = 4000
    share: float = 0.2
    least: int = 3
    slots: int = 1 << 18
    hashes: int = 3


def _letters() -> np.ndarray:
    """For every code point the lower-cased letter, 0 where it is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


_TABLE: list[np.ndarray] = []


def ngram_hashes(text: str, n: int) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of letters, in pieces; runs of other characters count as one gap.

    The text has a gap on both sides, and a text shorter than an n-gram gives one n-gram.
    """
    if not _TABLE:
        _TABLE.append(_letters())
    codes = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    filled = codes != 0
    if not filled.any():
        return
    codes = codes[filled | np.concatenate([[True], filled[:-1]])]
    if len(codes) < n:
        codes = np.concatenate([codes, np.zeros(n - len(codes), dtype=np.uint64)])
    for at in range(0, len(codes) - n + 1, _PIECE):
        part = codes[at:at + _PIECE + n - 1]
        value = np.zeros(len(part) - n + 1, dtype=np.uint64)
        for k in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + part[k:len(part) - n + 1 + k]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        yield value ^ (value >> np.uint64(29))


def _slots(hashes: np.ndarray, slots: int, count: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    for k in range(count):
        yield (hashes + step * np.uint64(k)) & np.uint64(slots - 1)


@dataclass(frozen=True)
class Filters:
    """Languages, their bit-sliced filter (slots x mask words) and each one's false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    settings: Settings

    def decide(self, text: str | None) -> tuple[str, float]:
        s, n_languages = self.settings, len(self.languages)
        counts, total = np.zeros(n_languages), 0
        for hashes in ngram_hashes(text or "", s.n):
            total += len(hashes)
            found = None
            for slot in _slots(hashes, s.slots, s.hashes):
                mask = self.masks[slot]
                found = mask if found is None else found & mask
            if n_languages <= 8:
                seen = np.bincount(found[:, 0].astype(np.uint8), minlength=256)
                for bit in range(n_languages):
                    counts[bit] += seen[(np.arange(256) >> bit & 1) == 1].sum()
            else:
                for bit in range(n_languages):
                    word, shift = divmod(bit, _WORD_BITS)
                    counts[bit] += np.count_nonzero(found[:, word] >> np.int64(shift) & np.int64(1))
        if not total or not n_languages:
            return UNDECIDED, 0.0
        share = np.clip((counts / total - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def learn(docs: DataFrame, may_learn: Column, settings: Settings = Settings(), text: str = "text",
          lang: str = "lang", seed: int = 0) -> Filters:
    """Learn the filters from the rows where ``may_learn`` holds and text and language are not null.

    The document counts of n-grams are summed per task and then over all tasks; the driver receives at
    most ``slots`` mask words. Without a row to learn from, every text stays undecided.
    """
    spark = docs.sparkSession
    rows = docs.filter(may_learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    languages = [r["lang"] for r in sizes]
    width = max(1, -(-len(languages) // _WORD_BITS))
    if not languages:
        return Filters([], np.zeros((settings.slots, 1), np.int64), np.zeros(0), settings)
    take = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, settings.fit_rows / r["n"]))])
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    n = settings.n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            docs_of: dict[str, int] = {}
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs_of[name] = docs_of.get(name, 0) + 1
                parts = list(ngram_hashes(value, n))
                if parts:
                    by_lang.setdefault(name, []).append(np.unique(np.concatenate(parts)))
            for name, arrays in by_lang.items():
                hashes, numbers = np.unique(np.concatenate(arrays), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array([name] * len(hashes)), pa.array(numbers)],
                    names=["h", "lang", "n"])
            for name, number in docs_of.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None], pa.int64()), pa.array([name]), pa.array([number])], names=["h", "lang", "n"])

    counted = rows.filter(draw < F.get(F.array(F.element_at(take, F.col("lang"))), F.lit(0)))
    counted = counted.mapInArrow(count, "h long, lang string, n long")
    counted = written(counted.groupBy("h", "lang").agg(F.sum("n").alias("n")), "language-counts")
    size_of = {r["lang"]: r["n"] for r in counted.filter("h is null").collect()}
    bit_of = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    docs_in = F.create_map(*[F.lit(x) for name in languages for x in (name, float(size_of.get(name, 1)))])
    rated = counted.filter("h is not null").withColumn("rate", F.col("n") / F.element_at(docs_in, F.col("lang")))
    entries = F.collect_list(F.struct("lang", "n", "rate"))
    top = rated.groupBy("h").agg(F.max("rate").alias("top"), entries.alias("all"))
    member = top.select("h", "top", F.explode("all").alias("e")).filter(
        (F.col("e.n") >= settings.least) & (F.col("e.rate") >= settings.share * F.col("top")))
    member = member.withColumn("bit", F.element_at(bit_of, F.col("e.lang")))
    step = F.shiftrightunsigned("h", 33).bitwiseOR(F.lit(1))
    slots = F.transform(F.sequence(F.lit(0), F.lit(settings.hashes - 1)), lambda k: (
        F.expr("h").bitwiseAND(F.lit(settings.slots - 1)) + step.bitwiseAND(F.lit(settings.slots - 1)) * k
    ).bitwiseAND(F.lit(settings.slots - 1)))
    cells = member.select(
        F.explode(slots).alias("slot"), (F.col("bit") / _WORD_BITS).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, cast(bit % {_WORD_BITS} as int))").alias("mask"),
    ).groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((settings.slots, width), dtype=np.int64)
    masks[cells["slot"].to_numpy(np.int64), cells["word"].to_numpy(np.int64)] = cells["mask"].to_numpy(np.int64)
    filled = np.array([
        np.count_nonzero(masks[:, b // _WORD_BITS] >> np.int64(b % _WORD_BITS) & np.int64(1))
        for b in range(len(languages))
    ])
    false_rate = np.minimum(0.999, (filled / settings.slots) ** settings.hashes)
    return Filters(languages, masks, false_rate, settings)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]


def identify(docs: DataFrame, filters: Filters, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``lang_pred`` and ``lang_score`` (0 to 1) of every whole text, beside the columns in ``keep``.

    A null text or one without a letter is undecided (``und``, score 0). Equal shares go to the language
    that sorts first. Repeated rows are each decided; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def compute():
        decide = shared.value.decide
        return lambda columns: list(zip(*(decide(t.as_py()) for t in columns[0]), strict=True))

    others = [name for name in keep if name != text]
    return map_arrow(docs, [text, *others], FIELDS, compute, inputs=1, kept_inputs=int(text in keep))
