"""Golden rows of the text expressions, worked out by hand from the definitions."""

import pytest
from pyspark.sql import functions as F

from precis.functions import counts, stemming, text


def one(spark, value, expression, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("given, expected", [
    ("[Music] Hello   World", "hello world"),
    (">> So\n>>> yes", "so yes"),
    ("a [] b", "a [] b"),
    ("a 　b", "a b"),
    ("a\u001cb", "a b"),
    ("   ", ""),
])
def test_clean(spark, given, expected):
    assert one(spark, given, text.clean_transcript) == expected


@pytest.mark.parametrize("given, n", [("", 0), ("one", 1), ("one two", 2)])
def test_token_count(spark, given, n):
    assert one(spark, given, text.token_count) == n
    assert len(one(spark, given, text.words)) == n


def test_space_characters_match_the_pattern(spark):
    every = "".join(chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000)
    left = one(spark, every, lambda c: F.regexp_replace(c, text.SPACE, ""))
    assert set(every) - set(left) == set(text.SPACE_CHARS)
    assert set(text.SPACE_CHARS) == {c for c in every if c.isspace()}


def test_sections(spark):
    cut = lambda c: text.word_sections(c, 2)
    assert one(spark, list("abcde"), cut, "array<string>") == ["a b", "c d", "e"]
    assert one(spark, [], cut, "array<string>") == []


@pytest.mark.parametrize("given, expected", [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]),
    ('He said "no." Then left.', ['He said "no."', "Then left."]),
    ("Dr. No met Mr. Yes. They sat.", ["Dr. No met Mr. Yes.", "They sat."]),
    ("Pi is 3.14 or so.\n\nNext", ["Pi is 3.14 or so.", "Next"]),
    ("last. word st. ends", ["last.", "word st. ends"]),
    ("  ", []),
    ("a\u0001b. c", ["a b.", "c"]),
])
def test_split_sentences(spark, given, expected):
    assert one(spark, given, text.split_sentences) == expected


def test_fallback(spark):
    given = "we test, it works so we ship and rest"
    assert one(spark, given, text.add_fallback_stops) == "we test. it works. so we ship. and rest"
    parts = one(spark, given, lambda c: text.lecture_sentences(c, min_chars=1))
    assert parts == ["we test.", "it works.", "so we ship.", "and rest"]


def test_merge_short(spark):
    a, b = "a" * 45, "b" * 50
    merged = one(spark, ["hi", a, "ok", "yes", b], text.merge_short, "array<string>")
    assert merged == ["hi", f"{a} ok yes", b]
    assert one(spark, [], text.merge_short, "array<string>") == []


def test_rouge_text(spark):
    assert one(spark, "Été, A-1!", text.rouge_text) == "t a 1"


def test_terms(spark):
    got = one(spark, "The cat, a CAT sat", lambda c: text.feature_terms(c, ["the"], 2))
    assert got == ["cat", "cat", "sat", "cat cat", "cat sat"]


def test_counts(spark):
    got = one(spark, ["b", "a", "b"], counts.term_counts, "array<string>")
    assert [(r["term"], r["tf"]) for r in got] == [("a", 1), ("b", 2)]
    assert one(spark, [], counts.term_counts, "array<string>") == []


@pytest.mark.parametrize("name, topic", [
    ("Deep Learning with Transformers", "NLP"),
    ("URL Shortener in Flask", "RL"),
    ("Thai Cooking", "AI: General/Papers"),
    ("Pandas Tutorial", "DS/Stats"),
    ("Gardening", "Other"),
    (None, "Other"),
])
def test_topic(spark, name, topic):
    assert one(spark, name, text.topic_of) == topic


@pytest.mark.parametrize("word, expected", [
    ("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"),
    ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("conflated", "conflat"), ("sized", "size"),
    ("falling", "fall"), ("happy", "happi"), ("triplicate", "triplic"), ("adoption", "adopt"),
    ("probate", "probat"), ("controlling", "control"), ("generalizations", "gener"),
    ("dying", "die"), ("news", "news"), ("the", "the"), ("was", "was"),
])
def test_stem(word, expected):
    assert stemming.stem(word) == expected


def test_stem_text(spark):
    assert one(spark, "hopping cats\nponies", stemming.stem_text) == "hop cat\nponi"
