"""Linear fits on numbered rows beside those by joins."""

import numpy as np
import pytest

from precis.operators import linear
from tests.test_linear import dense, labeled, parameters


@pytest.mark.parametrize("loss", ["logistic", "squared"])
def test_both_ways_take_the_same_steps(spark, monkeypatch, loss):
    rows = labeled(spark)
    joins = []
    with monkeypatch.context() as m:  # rows do not meet their terms by a join
        m.setattr(linear, "_margins", lambda *_: joins.append(1))
        found = linear.fit(rows, [], loss, max_iter=4)
        length = linear.gradient_length(found)
    assert not joins
    monkeypatch.setattr(linear, "MOST_PARAMETERS", 0)
    joined = linear.fit(rows, [], loss, max_iter=4)
    terms = dense(found)[0]
    assert np.allclose(parameters(found, terms), parameters(joined, terms), atol=1e-8)
    assert (found.n_steps, found.start, found.end) == pytest.approx((joined.n_steps, joined.start, joined.end), rel=1e-6)
    assert length == pytest.approx(linear.gradient_length(joined), rel=1e-6) == pytest.approx(found.end, rel=1e-6)


def test_rows_of_one_key_are_joined(spark):
    rows = labeled(spark, 40)
    assert linear.fit(rows, [], max_iter=0).unique
    assert not linear.fit(rows.unionByName(rows.where("doc_id = 1")), [], max_iter=0).unique
