"""Collocations of words by dynamic itemset counting.

The documents are dealt into a few shards, which are scanned in a cycle, one job each. All words are counted
from the first shard on. As soon as both parts of a longer phrase (all words but the last, all but the
first) have reached the threshold, the phrase is counted too, from the next shard on, together with the
shorter ones that are still open. A phrase is complete when it has been through every shard once.

* What is active need not be listed. Those that have reached the threshold are told to the tasks by a bit field of
  fixed size (a Bloom filter). A phrase is active in a step if the filter of this step has both its parts and the
  filter of one cycle earlier has not. Filters only grow, so every phrase is counted for exactly one cycle; a false
  positive starts a phrase early or without need, and no count is wrong or lost by it.
* Counts are a written table ``lang, phrase, k, first, total, reached``, which each step merges with the counts of its
  shard. What has been through its cycle and stayed below the threshold leaves it.
* Phrases are counted in each task by groups of a few megabytes of text, by numbers that are exact within the group;
  the text of a phrase is its key from there on, so no hash decides about a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import dropped, written, written_to
from precis.sources.store import fresh_path

_GROUP = 4 << 20  # bytes of text that are counted together
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)

# Classes of bytes: 0 within a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[9, 32]] = 1
_CLASS[[10, 11, 12, 13, *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Settings:
    """``least`` occurrences make a candidate of up to ``longest`` words. ``shards`` is the length of the cycle.
    ``filter_bits`` (a power of two) is the size of a filter; with many more phrases above the threshold than a
    quarter of it, more is counted than needed."""

    least: int = 30
    longest: int = 4
    shards: int = 2
    filter_bits: int = 1 << 24
    same_share: int = 80  # hundredths of a phrase's occurrences that a longer phrase holds
    top: int = 2000


# --- the filters -----------------------------------------------------------------------------


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(29))
    values = values * _MULTIPLIERS[1]
    return values ^ (values >> np.uint64(32))


def _text_hashes(texts: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(texts, categorize=False)


def _word_hashes(lang: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of words of languages, from the hashes of their texts."""
    return _mixed(lang * _MULTIPLIERS[0] + words)


def _longer(hashes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of all words but the last and of the last."""
    return _mixed(hashes * _MULTIPLIERS[2] + following + np.uint64(1))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(37)) & mask


def _contains(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter holds what has these hashes."""
    found = np.ones(len(hashes), dtype=bool)
    for place in _places(hashes, len(field) * 64):
        found &= (field[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _filter_rows(bits: int):
    """From rows ``lang, phrase``: the words of the filter that they set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column(0).to_numpy(zero_copy_only=False)
            parts = pc.split_pattern(batch.column(1), " ")
            lengths = pc.list_value_length(parts).to_numpy()
            starts = np.cumsum(lengths) - lengths
            words = _text_hashes(parts.flatten().to_numpy(zero_copy_only=False))
            words = _word_hashes(np.repeat(_text_hashes(lang), lengths), words)
            hashes = words[starts]
            for k in range(1, int(lengths.max())):
                more = np.flatnonzero(lengths > k)
                hashes[more] = _longer(hashes[more], words[starts[more] + k])
            places = np.sort(np.concatenate(_places(hashes, bits)))
            word = (places >> np.uint64(6)).astype(np.int64)
            edges = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            value = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), edges)
            yield pa.RecordBatch.from_arrays([pa.array(word[edges]), pa.array(value.view(np.int64))], names=["word", "bits"])

    return run


def _filter(counts: DataFrame, s: Settings) -> np.ndarray:
    """The filter of all phrases that have reached the threshold and may be parts of longer ones.

    At most ``filter_bits / 64`` rows of two numbers come to the driver, whatever the number of phrases.
    """
    known = counts.filter((F.col("k") < s.longest) & F.col("reached").isNotNull()).select("lang", "phrase")
    rows = known.mapInArrow(_filter_rows(s.filter_bits), "word long, bits long")
    rows = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros(s.filter_bits // 64, dtype=np.uint64)
    field[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return field


# --- counting --------------------------------------------------------------------------------


def _groups(column: pa.Array, lang: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, starts of texts, and languages of texts with their numbers, in groups of about ``_GROUP`` bytes.

    A longer text is cut where a piece ends, so that only a piece has to fit into memory.
    """
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    coded = lang.dictionary_encode()
    names, codes = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _GROUP, side="right")) - 1)
        low, high = int(offsets[at]), int(offsets[end])
        if end == at + 1:
            while high - low > _GROUP:
                cut = low + _GROUP
                while cut < high:
                    breaks = np.flatnonzero(_CLASS[data[cut:min(cut + _GROUP, high)]] == 2)
                    if len(breaks):
                        cut += int(breaks[0])
                        break
                    cut = min(cut + _GROUP, high)
                yield data[low:cut], np.zeros(1, np.int64), codes[at:end], names
                low = cut
            yield data[low:high], np.zeros(1, np.int64), codes[at:end], names
        else:
            yield data[low:high], offsets[at:end] - low, codes[at:end], names
        at = end


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words, the number of the text each stands in, and whether the next word is in the same piece."""
    kind = _CLASS[data]
    inside = kind == 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = edge[-1] = True
    first = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | edge[:-1]))
    last = np.flatnonzero(inside & (np.append(~inside[1:], True) | edge[1:])) + 1
    owner = np.searchsorted(starts, first, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), first)
    together = np.zeros(len(first), dtype=bool)
    together[:-1] = (piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1])
    letters = _LOWER[data[inside]]
    ends = np.cumsum(last - first)
    offsets = np.append(0, ends).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return pa.DictionaryArray.from_arrays(coded.indices, coded.dictionary.cast(pa.large_string())), owner, together


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each occurs."""
    keys = np.sort(keys)
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[edges], np.diff(np.append(edges, len(keys)))


def _numbered(keys: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys (all below ``span``), their counts, and the number of the key of each row."""
    if span > 8 * len(keys) + (1 << 16):
        names, count = _counted(keys)
        return names, count, np.searchsorted(names, keys)
    count = np.bincount(keys, minlength=span)
    names = np.flatnonzero(count)
    number = np.empty(span, dtype=np.int64)
    number[names] = np.arange(len(names))
    return names, count[names], number[keys]


def _count(step: int, s: Settings, shared):
    """Rows ``lang, phrase, k, count`` of the phrases that are active in a step; ``k`` 0 counts all words."""
    header = ["lang", "phrase", "k", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, before = shared.value

        def counted_group(data, starts, codes, langs) -> Iterator[pa.RecordBatch]:
            words, owner, together = _words(data, starts)
            if not len(words):
                return
            lang = codes[owner]

            def rows(parts: list[np.ndarray], count: np.ndarray) -> pa.RecordBatch:
                texts = [words.dictionary.take(pa.array(names[p] // len(langs))) for p in parts]
                text = pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string())) if len(texts) > 1 else texts[0]
                of_lang = lang_names.take(pa.array(names[parts[0]] % len(langs)))
                return pa.RecordBatch.from_arrays(
                    [of_lang, text.cast(pa.string()), pa.array(np.full(len(count), len(parts), np.int32)), pa.array(count)], names=header)

            # A word is a number for its text and its language.
            lang_names = pa.array(langs, pa.string())
            number = words.indices.to_numpy().astype(np.int64) * len(langs) + lang
            names, count, word = _numbered(number, len(words.dictionary) * len(langs))
            if step < s.shards:
                yield rows([np.arange(len(names))], count)
                n = np.bincount(lang, minlength=len(langs))
                present = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [lang_names.take(pa.array(present)), pa.array([""] * len(present), pa.string()),
                     pa.array(np.zeros(len(present), np.int32)), pa.array(n[present])], names=header)
            texts = _text_hashes(words.dictionary.to_numpy(zero_copy_only=False))
            hashes = _word_hashes(_text_hashes(langs)[names % len(langs)], texts[names // len(langs)])
            known, old = _contains(reached, hashes)[word], _contains(before, hashes)[word]
            # at: where a phrase of the length at hand begins that has reached the threshold; done: a cycle ago.
            single, at = hashes[word], np.flatnonzero(known)
            value, done = single[at], old[at]
            for k in range(2, s.longest + 1):
                # Both parts of the longer phrase: the one that begins here and the one at the next word.
                here = np.flatnonzero(np.append(at[1:] == at[:-1] + 1, False) & together[at]) if len(at) else at
                both = done[here] & done[here + 1]
                begin = at[here[~both]]
                if len(begin):
                    # A phrase is a number for all but its last word, and that word.
                    keys, shorter = word[begin] * len(names) + word[begin + 1], []
                    for j in range(2, k):
                        shorter.append(_counted(keys)[0])
                        keys = np.searchsorted(shorter[-1], keys) * len(names) + word[begin + j]
                    keys, n = _counted(keys)
                    parts = [keys % len(names)]
                    for below in reversed(shorter):
                        keys = below[keys // len(names)]
                        parts.append(keys % len(names))
                    yield rows([keys // len(names), *reversed(parts)], n)
                at, value = at[here], _longer(value[here], single[at[here] + k - 1])
                keep = _contains(reached, value)
                at, value = at[keep], value[keep]
                # As above, with all shorter parts: the earlier filter may hold a phrase falsely before these were known.
                done = both[keep] & _contains(before, value)

        for batch in batches:
            for group in _groups(batch.column(1), batch.column(0)):
                yield from counted_group(*group)

    return run


def _merged(counts: DataFrame | None, found: DataFrame, step: int, s: Settings) -> DataFrame:
    """The counts with those of one more shard, without what its full cycle has left below the threshold."""
    none = F.lit(None).cast("int")
    rows = found.select("lang", "phrase", "k", F.lit(step).alias("first"), F.col("count").alias("total"), none.alias("reached"))
    if counts is not None:
        rows = rows.unionByName(counts)
    merged = rows.groupBy("lang", "phrase").agg(
        F.max("k").alias("k"), F.min("first").alias("first"), F.sum("total").alias("total"), F.min("reached").alias("reached"))
    now = F.when((F.col("k") > 0) & (F.col("total") >= s.least), F.lit(step))
    kept = merged.withColumn("reached", F.coalesce("reached", now)).select("lang", "phrase", "k", "first", "total", "reached")
    open_ = F.col("first") + s.shards - 1 > step
    return kept.filter(F.col("reached").isNotNull() | (F.col("k") == 0) | open_)


def frequent_phrases(docs: DataFrame, s: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, phrase, k, total`` of every phrase of ``k`` words that occurs at least ``least`` times.

    Words, pieces and null values as in :func:`collocations`. A row with ``k`` 0 and an empty phrase has the number of all
    words of the language.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Row numbers of a task deal out equal shares, whatever the texts; the written table fixes them.
    source = source.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(s.shards)).cast("int"))
    folder = fresh_path(spark, "shards")
    source.write.partitionBy("shard").parquet(folder)
    shards = spark.read.schema(source.schema).parquet(folder)

    filters = [np.zeros(s.filter_bits // 64, dtype=np.uint64)] * (s.shards + 1)  # of the last steps, the latest last
    counts, path, step = None, None, 0
    while True:
        shared = spark.sparkContext.broadcast((filters[-1], filters[0]))
        shard = shards.filter(F.col("shard") == step % s.shards).select("lang", "text")
        found = shard.mapInArrow(_count(step, s, shared), "lang string, phrase string, k int, count long")
        last, path = path, fresh_path(spark, "phrase-counts")
        counts = written_to(_merged(counts, found, step, s), path)
        shared.destroy()
        if last is not None:
            dropped(spark, last)
        step += 1
        filters = [*filters[1:], _filter(counts, s)]
        if step >= s.shards and np.array_equal(filters[0], filters[-1]):
            break
    dropped(spark, folder)
    return counts.filter((F.col("k") == 0) | (F.col("total") >= s.least)).select("lang", "phrase", "k", "total")


# --- scores ----------------------------------------------------------------------------------


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _inner(words: Column, k: Column) -> Column:
    """All phrases of at least two words inside a phrase of ``k`` words."""
    of_length = lambda n: F.transform(F.sequence(F.lit(1), k - n + 1), lambda at: _part(words, at, n))
    return F.flatten(F.transform(F.sequence(F.lit(2), k - 1), of_length))


def collocations(docs: DataFrame, s: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language that hold together best.

    A-Z are lower-cased. ``.,;:!?`` and line breaks (LF to CR) end a piece, blanks and tabs end a word. A phrase of two
    to ``longest`` words of one piece that occurs ``a`` times, ``least`` or more, is a candidate; overlaps count. Its weakest cut
    into a beginning (``l`` times) and a rest (``r``) gives the score floor(2000000 a / (l + r)). One that lies
    inside a longer candidate with ``same_share`` hundredths of ``a`` is left out. ``n`` is the number of words of the language.

    A null text is empty, a null language is ``und``, together with the rows that say so. Rows count as often as they
    occur. Equal scores are ordered by ``a``, then by the bytes of the phrase. No rows give no rows. A text of any
    length is cut where pieces end; only a piece has to fit into a task. Other columns are not looked at.
    """
    found = frequent_phrases(docs, s, text, lang)
    known = written(found, "frequent-phrases")
    words = known.filter("k = 0").select("lang", F.col("total").alias("n"))
    parts = known.filter("k > 0").select("lang", "phrase", "total")
    longer = known.filter("k > 1").select("lang", "phrase", "k", F.col("total").alias("a"), F.split("phrase", " ").alias("words"))

    cuts = longer.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", _part(F.col("words"), F.lit(1), F.col("cut")).alias("head"),
        _part(F.col("words"), F.col("cut") + 1, F.col("k")).alias("rest"))
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("total").alias("l"))
    rests = parts.select("lang", F.col("phrase").alias("rest"), F.col("total").alias("r"))
    # Products may pass 64 bits, so they are decimals.
    score = F.expr("2000000 * cast(a AS decimal(20, 0)) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    scored = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest"))

    inside = longer.filter("k > 2").select("lang", "a", F.explode(_inner(F.col("words"), F.col("k"))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda name, factor: F.col(name).cast("decimal(20, 0)") * factor
    within = F.col("longer").isNotNull() & (wide("longer", 100) >= wide("a", s.same_share))
    own = weakest.join(inside, ["lang", "phrase"], "left").filter(~within)
    own = own.select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
