"""Terms counted by Arrow batches against the expressions that count them row by row."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from precis.functions import bags, counts, text
from precis.operators import features, labels, naive_bayes

ODD = [None, "", "a", "The cat, a CAT sat; the cat", "été ÉTÉ naïve", "中文 中文 zz", "x_1 x_1 x_1 \U0001d7d8\U0001d7d9 aa", "!! ??", "zz aa zz aa"]


def _random_rows(n, seed=1):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.7)) % 300}" for _ in range(4000)]
    return [(i // 5, i % 5, " ".join(draw.choices(words, k=draw.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("max_n", [1, 2])
def test_counts_are_those_of_the_expressions(spark, monkeypatch, max_n):
    monkeypatch.setattr(bags, "MOST_TOKENS", 5)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "doc_id long, sentence string").coalesce(1)
    found = features.with_term_counts(df, "sentence", ["the"], max_n).select("doc_id", "terms")
    plain = df.select("doc_id", counts.term_counts(text.feature_terms(F.col("sentence"), ["the"], max_n)).alias("terms"))
    assert sorted(found.collect()) == sorted(plain.collect())


def test_frequent_terms_are_counted_within_few_buckets(spark):
    """Exact with ties at the cut, and with a bound that is first too high."""
    df = spark.createDataFrame(_random_rows(400), "doc_id long, sentence_id int, sentence string")
    counted = features.with_term_counts(df, "sentence", [], 2)
    weight = F.col("sentence_id") + 1
    for n in (1, 7, 100, 100_000):
        found = features.frequent_term_stats(counted, n, weight).collect()
        assert sorted(found) == sorted(features.most_frequent(features.term_stats(counted, weight), n).collect())


def test_buckets_depend_on_the_string_alone():
    terms = pa.array(["b", "ab", "ba", "é", "ab", "a" * 500])
    whole, part = bags.buckets(terms), bags.buckets(terms.slice(2, 3))
    assert (whole[2:5] == part).all() and whole[1] == whole[4] and len(set(whole)) == 5
    assert whole.min() >= 0 and whole.max() < 1 << bags.BUCKET_BITS
    assert len(np.unique(bags.buckets(pa.array([f"w{i}" for i in range(1000)])))) > 980


def test_cosine_sums_agree_with_the_join(spark, monkeypatch):
    rows = [(1, ["green apples fall", "dogs bark", "", "apples apples green"], "green apples fall"), (2, [], "x"), (3, None, "a"),
            (4, ["one two", None], None), (None, ["aa bb", "bb cc"], "bb bb"), (1, ["green dogs"], "dogs")]
    docs = spark.createDataFrame(rows, "doc_id long, sentences array<string>, summary string")
    idf = labels.fit_summary_idf(docs, [])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = sorted(map(tuple, labels.cosine_scores(docs, idf, []).collect()), key=key)
    monkeypatch.setattr(labels, "MOST_NAMES", 0)
    joined = sorted(map(tuple, labels.cosine_scores(docs, idf, []).collect()), key=key)
    assert [r[:2] for r in found] == [r[:2] for r in joined]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in joined])


def test_bayes_reads_terms_that_are_given(spark, monkeypatch):
    """Rows with terms are neither split into words again, nor scored otherwise."""
    rows = [(i, j, s, int(j == 0)) for i, j, s in _random_rows(60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, sentence_id int, sentence string, label int")
    plain = naive_bayes.score(naive_bayes.fit(df, []), df).collect()
    given = naive_bayes.with_terms(df, []).drop("sentence")
    monkeypatch.setattr(features, "with_term_counts", None)
    found = naive_bayes.score(naive_bayes.fit(given, []), given).collect()
    assert [tuple(r)[:2] for r in sorted(found)] == [tuple(r)[:2] for r in sorted(plain)]
    assert [r["score"] for r in sorted(found)] == pytest.approx([r["score"] for r in sorted(plain)])


def test_spaces_collapse_as_with_one_pattern(spark):
    draw = random.Random(5)
    signs = [*text.SPACE_CHARS, *"    ab​"]
    df = spark.createDataFrame([("".join(draw.choices(signs, k=draw.randint(0, 30))),) for _ in range(2000)], "t string")
    plain = F.trim(F.regexp_replace("t", f"{text.SPACE}+", " "))
    assert df.where(~plain.eqNullSafe(text.collapse_space(F.col("t")))).count() == 0
