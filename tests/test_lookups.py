"""Rows that meet their terms by a table in every task: the results of the joins, without shuffling a term of a row."""

import os
import random

import pytest

from precis.operators import features, labels, lookups, naive_bayes
from precis.plans import queries
from precis.sources import store


def sentences(spark, n=80):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    made = [(i // 4, i % 4, " ".join(rng.choice(words[i % 3:]) for _ in range(rng.randrange(6))), int(i % 3 == 0)) for i in range(n)]
    made += [(500, 0, None, 1), (501, 0, "!", 0)]
    return spark.createDataFrame(made, "doc_id long, sentence_id int, sentence string, label int")


def scores(model, rows):
    found = [(r["doc_id"], r["sentence_id"], r["prediction"], r["score"]) for r in naive_bayes.score(model, rows).collect()]
    found.sort()
    return [f[:3] for f in found], [f[3] for f in found]


@pytest.mark.parametrize("twice", [False, True])
def test_bayes_equals_the_joined_one(spark, monkeypatch, twice):
    rows = sentences(spark)
    if twice:  # rows of one key are one vector
        rows = rows.unionByName(rows.where("doc_id < 9"))
    others = rows.unionByName(spark.createDataFrame([(900, 0, "unheard alpha unheard", 0), (901, 0, "unheard", 1)], rows.schema))
    given = scores(naive_bayes.fit(rows, []), others)
    monkeypatch.setattr(lookups, "MOST_TERMS", 0)
    joined = scores(naive_bayes.fit(rows, []), others)
    assert given[0] == joined[0] and len(given[0]) == 84
    assert given[1] == pytest.approx(joined[1], abs=1e-12)


def test_no_term_of_a_row_is_shuffled(spark):
    rows = naive_bayes.with_terms(sentences(spark), [])
    plan = naive_bayes.score(naive_bayes.fit(rows, []), rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc_id" in plan
    assert "Join" not in plan and "Generate" not in plan


def test_equal_hashes_are_joined(spark, monkeypatch):
    from precis.functions import lookup

    terms = features.fit_idf(features.with_term_counts(sentences(spark), "sentence", [])).select("term", "idf")
    assert lookups.shared(terms, "idf") is not None
    monkeypatch.setattr(lookups, "MOST_TERMS", 6)
    assert lookups.shared(terms, "idf") is None
    assert list(lookup.places(lookup.np.array([], lookup.np.int64), lookup.pa.array(["a"]))) == [-1]


def test_terms_of_the_tokens_are_those_of_the_sentences(spark, monkeypatch, tmp_path):
    golds = spark.createDataFrame(
        [(1, ["Alpha beta, alpha!", "", "the gamma"], "alpha gamma"), (2, ["delta"], None), (2, ["beta beta", "omega"], "omega"), (3, [], "alpha"), (None, ["alpha"], "beta")],
        "doc_id long, sentences array<string>, summary string",
    )
    found = labels.label_by_cosine(golds, ["the"], k=1)
    split = spark.createDataFrame([(1, "train"), (2, "test"), (2, "test"), (3, "val")], "doc_id long, part string")
    rows = labels.attach_labels(golds, found).join(split, "doc_id")
    old = features.with_term_counts(rows, "sentence", ["the"]).drop("sentence")
    new = labels.attach_to_terms(labels.unit_tokens(golds, ["the"]).join(split, "doc_id"), found, "part")
    key = lambda r: str(sorted(r.asDict(recursive=True).items()))
    assert sorted(map(key, old.collect())) == sorted(map(key, new.collect())) and old.count() == 9


def test_only_what_is_read_again_stays(spark, monkeypatch):
    folder = store.fresh_path(spark, "kept").removeprefix("file:")
    golds = spark.createDataFrame([(1, ["Alpha beta", "the gamma"], "alpha")], "doc_id long, sentences array<string>, summary string")
    monkeypatch.setattr(store, "shared_dir", lambda _: folder)
    monkeypatch.setattr(queries, "_gold_lectures", lambda *_: golds)
    monkeypatch.setattr(queries, "split_by_doc", lambda *_: store.staged(golds.selectExpr("doc_id", "'train' part"), "split"))
    _, rows = queries._labeled_terms(spark, "nowhere")
    assert sorted(x.split("-")[0] for x in os.listdir(folder)) == ["lectures", "term"]
    assert sorted(rows.columns) == ["doc_id", "label", "part", "sentence_id", "terms"] and rows.count() == 2
    queries._labeled(spark, "nowhere")
    assert sorted(x.split("-")[0] for x in os.listdir(folder)) == ["labeled", "lectures", "lectures", "term"]
