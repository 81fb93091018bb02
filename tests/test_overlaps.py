from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from precis.functions import lcs, overlaps, stemming
from precis.operators import rouge


def _texts(rng, n, words):
    return [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("stem", [False, True])
def test_overlaps_equal_plain_counts(stem):
    rng = np.random.default_rng(3)
    words = ["cat", "cats", "hopping", "hops", "hop", "a", "b", "7"]
    left, right = _texts(rng, 60, words) + ["", "a", ""], _texts(rng, 60, words) + ["a b", "", ""]
    pairs = overlaps._Pairs(pa.array(left), pa.array(right), stemming.Stems() if stem else None)
    tokens = [[[stemming.stem(w) if stem else w for w in t.split()] for t in side] for side in (left, right)]
    expected = [
        (len(c), len(r), sum((Counter(c) & Counter(r)).values()),
         sum((Counter(zip(c, c[1:])) & Counter(zip(r, r[1:]))).values()), lcs.lcs_length(c, r))
        for c, r in zip(*tokens)
    ]
    got = zip(*pairs.lengths(), pairs.overlap1(), pairs.overlap2(), pairs.subsequence())
    assert [tuple(map(int, row)) for row in got] == expected


def test_slices_cover_all_rows(monkeypatch):
    monkeypatch.setattr(overlaps, "MOST_BYTES", 10)
    texts = pa.array(["", "a" * 25, "b" * 4, "c" * 4, "d" * 4, ""])
    assert list(overlaps._slices(texts)) == [(0, 1), (1, 1), (2, 2), (4, 2)]
    assert list(overlaps._slices(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("stem", [False, True])
def test_rouge_of_a_pair_is_one_arrow_step(spark, stem):
    """No n-gram becomes an element of a JVM array, and texts enter Python once."""
    df = spark.createDataFrame([(1, "the cat sat", "the cat")], "doc_id long, text string, reference string")
    plan = rouge.score_pairs(df, stem=stem)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and plan.count("EvalPython") == 1
