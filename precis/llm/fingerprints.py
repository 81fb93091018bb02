"""Document fingerprints by one-permutation MinHash. DataFrame functions only.

Every 5-word shingle is hashed once. The upper bits of the hash are its bin, and each bin keeps the
smallest hash in it. An empty bin borrows from a filled one (optimal densification): it asks the bins in
a random order of its own, the same in every document, until one is filled. Of each bin's hash only the
low-order bits are stored; the chance matches that this brings are corrected for in the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.functions.text import let
from precis.llm.common import written

_BIN_BITS = 7
BINS = 1 << _BIN_BITS
_STORED_BITS = 8
_NONE = -(1 << 63)


def _shingles(text: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words; a shorter text is one shingle."""
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    return let(words, lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))


def fingerprint(text: Column, n: int = 5) -> Column:
    """Hex string of ``BINS`` bytes; equal texts have equal fingerprints, an empty text has one too."""
    shift, low = 64 - _BIN_BITS, (1 << _STORED_BITS) - 1
    half = BINS // 2
    bin_of = lambda h: F.shiftright(h, shift)  # -half .. half - 1
    cell = lambda b, value: (b + half) * (low + 1) + value.bitwiseAND(F.lit(low))

    def densify(least: Column) -> Column:
        filled = F.transform(least, lambda h: cell(bin_of(h), h))
        every = F.sequence(F.lit(-half).cast("long"), F.lit(half - 1).cast("long"))
        empty = F.array_except(every, F.transform(least, bin_of))
        rank = lambda b, h: F.xxhash64(b, bin_of(h)).bitwiseAND(F.lit(~low)).bitwiseOR(h.bitwiseAND(F.lit(low)))
        borrowed = F.transform(empty, lambda b: cell(b, F.array_min(F.transform(least, lambda h: rank(b, h)))))
        return F.when(F.size(least) == BINS, filled).otherwise(F.array_sort(F.concat(filled, borrowed)))

    smallest = let(F.array_sort(_shingles(text, n)), lambda hs: F.filter(
        hs, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(hs, i - 1)))))
    cells = let(smallest, densify)
    return F.lower(F.array_join(F.transform(cells, lambda c: F.lpad(
        F.hex(c.bitwiseAND(F.lit(low))), _STORED_BITS // 4, "0")), ""))


def likeness(one: Column, two: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of equal bins, corrected for chance matches."""
    width = _STORED_BITS // 4
    at = lambda value, i: F.substring(value, i * width + 1, F.lit(width))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: at(one, i) == at(two, i)))
    chance = 2.0**-_STORED_BITS
    return F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))


def _following(docs: DataFrame) -> DataFrame:
    """``key, need, next_key``: for each different key the next smaller one (for the smallest the largest).

    Keys are sorted by range partitions; only the first key of each partition is looked at globally.
    """
    keys = docs.groupBy("key").agg(F.expr("max(char_length(text)) div 3").alias("need"))
    keys = written(keys.repartitionByRange(F.col("key").desc()).withColumn("part", F.spark_partition_id()), "keys")
    # One row for each range partition, so the window and the broadcast have a known bound.
    firsts = keys.groupBy("part").agg(F.max("key").alias("first"))
    by_part = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(
        F.lead("first").over(by_part), F.max("first").over(Window.partitionBy(F.lit(1)))).alias("after"))
    within = Window.partitionBy("part").orderBy(F.col("key").desc())
    return keys.join(F.broadcast(firsts), "part").select(
        "key", "need", F.coalesce(F.lead("key").over(within), F.col("after")).alias("next_key"))


def fingerprints_with_edits(docs: DataFrame, n: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and how alike they are.

    The edited text has its last third replaced by the beginning of the next document in descending
    order of ids. Texts move once, by id; of the next document only as much as is needed.

    A null text counts as empty. Null ids come last in the order. Rows that share an id have one next
    document, and as someone's next document the one whose needed text sorts first stands for them. A
    single document is its own next one; an empty table gives an empty table.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NONE))
    plain = docs.select(key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    links = _following(plain)
    # Both joins read these three columns by this key, so one shuffle serves them.
    printed = plain.withColumn("fingerprint", fingerprint(F.col("text"), n))
    following = printed.join(links.withColumnRenamed("key", "of"), F.col("key") == F.col("next_key"))
    heads = following.groupBy(F.col("of").alias("key")).agg(F.min(F.struct(
        F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("fingerprint").alias("next"))).alias("after"))
    joined = printed.join(heads, "key").withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.expr("cast(n_chars div 3 as int)")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third),
        F.substring(F.col("after.head"), F.lit(1), third))
    own_id = F.when(F.col("key") != _NONE, F.col("key")).alias("doc_id")
    done = joined.select(own_id, "n_chars", "fingerprint", F.col("after.next").alias("next"), edited.alias("edited"))
    done = done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next",
                       fingerprint(F.col("edited"), n).alias("edited_fingerprint"))
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))
