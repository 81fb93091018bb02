"""Collocations against a plain count of everything."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.llm import phrases
from precis.llm.phrases import Settings

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, s):
    counts, n = defaultdict(Counter), Counter()
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, s.longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    made = []
    for lang, f in counts.items():
        long = [p for p in f if len(p) > 1 and f[p] >= s.least]
        inside = Counter()
        for p in long:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], f[p])
        scored = []
        for p in long:
            if 100 * inside[p] >= s.same_share * f[p]:
                continue
            cuts = [(int(Fraction(2000000 * f[p], f[p[:c]] + f[p[c:]])), c, f[p[:c]], f[p[c:]]) for c in range(1, len(p))]
            score, _, l, r = min(cuts)
            scored.append((-score, -f[p], " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:s.top], 1):
            made.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(made)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def run(spark, rows, s, parts=5):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({c: F.lit(0) for c in ("phrase", "k", "shard", "n", "total")})
    made = phrases.collocations(docs, s)
    assert made.columns == COLUMNS
    return sorted(tuple(r) for r in made.collect())


def texts(seed, n):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(12)] + ["Über", "naïve", "A", "a", " x"]
    for i in range(n):
        parts = [" ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(9))) for _ in range(rng.randrange(6))]
        rows.append((i, rng.choice([". ", ",", "\n", "\t", "  "]).join(parts), rng.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("shards", [1, 3, 4])
def test_equals_brute_force(spark, shards):
    s = Settings(least=4, shards=shards, filter_bits=1 << 16)
    rows = texts(shards, 150)
    assert run(spark, rows, s) == brute(rows, s)


def test_a_crowded_filter_changes_nothing(spark):
    """Most of a filter of 64 bits is set, so that nearly everything is counted, and each phrase once."""
    s = Settings(least=5, shards=3, filter_bits=64)
    rows = texts(7, 200)
    assert run(spark, rows, s) == brute(rows, s)


@pytest.mark.parametrize("bits", [1 << 10, 1 << 12])
def test_a_phrase_that_a_filter_holds_falsely_is_counted(spark, bits):
    """Words cross the threshold in different steps while the filter holds longer phrases by chance."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    lines = [" ".join(rng.choices(words, k=rng.randrange(2, 7))) for _ in range(150)]
    rows = [(i, ". ".join(rng.choices(lines, k=2)), rng.choice(["en", "fr"])) for i in range(2500)]
    s = Settings(least=12, filter_bits=bits)
    assert run(spark, rows, s) == brute(rows, s)


def test_odd_rows(spark):
    s = Settings(least=3, shards=4, filter_bits=1 << 12, top=3)
    rows = [(1, None, "en"), (2, "", None), (3, " \t. ,", "en"), (None, "x y z", "und"), (4, "x y z", None), (4, "X Y z", None)]
    rows += [(5, "a b " * 10, "aa"), (6, "a a a a a", ""), (7, "p q! p q? p q", "é")] * 3
    assert run(spark, rows, s) == brute(rows, s)
    assert run(spark, [], s) == []
    assert run(spark, rows[:3], s) == []


def test_a_long_text_is_cut_where_a_piece_ends(spark):
    s = Settings(least=30, shards=2, filter_bits=1 << 16)
    rows = [(1, "one two three four five. " * 400_000, "en"), (2, "no end of this piece " * 300_000, "en"), (3, "one two", "en")]
    assert run(spark, rows, s) == brute(rows, s)


def test_numbers_of_many_languages():
    """Sparse keys are numbered as dense ones are."""
    keys = np.array([7, 3, 7, 900_000, 3, 7])
    for span in (900_001, 1 << 40):
        names, count, number = phrases._numbered(keys, span)
        assert names.tolist() == [3, 7, 900_000] and count.tolist() == [2, 3, 1] and number.tolist() == [1, 0, 1, 2, 0, 1]
    assert len(set(phrases._word_hashes(np.array([1, 2], np.uint64), np.array([5, 5], np.uint64)).tolist())) == 2
