from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from precis.functions import bags, units
from precis.operators import labels
from precis.sources import store

DOCS = [["aa bb aa", "bb cc", "aa bb"], None, ["", "cc dd", None], ["aa"], [], ["dd dd dd", "bb aa", "dd dd"]]


def _terms(unit, max_n):
    words = (unit or "").split()
    return words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if max_n == 2 else [])


def _units(max_n):
    return units.Units(pa.array(DOCS, pa.list_(pa.string())), max_n)


@pytest.mark.parametrize("max_n", [1, 2])
@pytest.mark.parametrize("once", [False, True])
def test_stats_and_totals_equal_plain_counts(max_n, once):
    df, total = Counter(), Counter()
    for doc in DOCS:
        for i, unit in enumerate(doc or []):
            times = 1 if i < len(doc) - 1 or once else len(doc) - 1
            for term, tf in Counter(_terms(unit, max_n)).items():
                df[term] += times
                total[term] += times * tf
    made = _units(max_n)
    everything = np.ones(1 << bags.BUCKET_BITS, bool)
    got = {r["term"]: (r["df"], r["total_tf"]) for r in made.stats(everything, once).to_pylist()}
    assert got == {t: (df[t], total[t]) for t in df}
    assert made.totals(once).sum() == sum(total.values())
    assert made.stats(~everything, once).num_rows == 0


@pytest.mark.parametrize("max_n", [1, 2])
def test_sums_equal_plain_products(max_n):
    idf = {"aa": 1.5, "bb": 2.0, "dd": 1.25, "aa bb": 3.0, "dd dd": 2.5, "xx": 9.0, "cc xx": 9.0}
    known = units.Known(pa.array(list(idf)), np.array(list(idf.values())))
    made = _units(max_n)
    expected = []
    for doc in DOCS:
        for i, unit in enumerate(doc or []):
            mine, summary = Counter(_terms(unit, max_n)), Counter(_terms(doc[-1], max_n))
            last = i == len(doc) - 1
            dot = sum(n * summary[t] * idf.get(t, 0) ** 2 for t, n in mine.items())
            expected.append((-1 if last else i, 0.0 if last else dot, sum((n * idf.get(t, 0)) ** 2 for t, n in mine.items())))
    dot, own = made.sums(known)
    assert list(zip(made.numbers().tolist(), dot.tolist(), own.tolist())) == [pytest.approx(e) for e in expected]


def test_cosine_labels_write_no_lists_of_terms(spark, monkeypatch):
    golds = spark.createDataFrame(
        [(1, ["red apples grow", "blue boats sail"], "boats sail"), (2, ["green pears"], None)],
        "doc_id long, sentences array<string>, summary string",
    )
    written = []
    real = store.staged
    monkeypatch.setattr(store, "staged", lambda df, name: written.append(df.schema.simpleString()) or real(df, name))
    found = {(r["doc_id"], r["sentence_id"]): r["score"] for r in labels.label_by_cosine(golds, [], k=1).collect()}
    assert found[(1, 0)] == 0 and 0 < found[(1, 1)] < 1 and found[(2, 0)] == 0
    assert not any("array<struct" in schema for schema in written)
