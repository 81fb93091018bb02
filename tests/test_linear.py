"""Linear models in long form against dense versions in numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.operators import linear

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]


def labeled(spark, n=120, seed=3):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        label = int(rng.random() < 0.3)
        words = [rng.choice(WORDS[: 4 if label else 7]) for _ in range(rng.randint(1, 6))]
        made.append((i // 4, i % 4, " ".join(words), label))
    made += [(10_000, 0, "", 1), (10_000, 1, "a !", 0), (10_001, 0, None, 0)]  # rows without terms
    return spark.createDataFrame(made, "doc_id long, sentence_id int, sentence string, label int")


def dense(model):
    """The training rows as a matrix with a last column of ones."""
    rows = model.rows.orderBy("doc_id", "sentence_id").collect()
    terms = sorted({t["term"] for r in rows for t in r["terms"]})
    at = {t: i for i, t in enumerate(terms)}
    x = np.zeros((len(rows), len(terms) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        for t in r["terms"]:
            x[i, at[t["term"]]] = t["x"]
    return terms, x, np.array([r["label"] for r in rows], float), np.array([r["c"] for r in rows])


def parameters(model, terms):
    found = {r["term"]: r["w"] for r in model.terms.collect()}
    assert sorted(found) == terms
    return np.array([found[t] for t in terms] + [model.intercept])


def test_logistic_equals_newton(spark):
    model = linear.fit(labeled(spark), [], tolerance=1e-5)
    terms, x, y, c = dense(model)
    assert sum(c[y == 1]) == pytest.approx(sum(c[y == 0])) == pytest.approx(len(y) / 2)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (c * (p - y)) + w
        w -= np.linalg.solve((x.T * (c * p * (1 - p))) @ x + np.eye(len(w)), gradient)
    assert np.allclose(parameters(model, terms), w, atol=1e-3)
    assert linear.gradient_length(model) == pytest.approx(model.end, rel=1e-2, abs=1e-6)
    assert model.end <= 1e-5 * model.start


def test_squared_equals_least_squares(spark):
    model = linear.fit(labeled(spark), [], "squared", c=math.inf, tolerance=1e-4)
    terms, x, y, _ = dense(model)
    assert np.allclose(x @ parameters(model, terms), x @ np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-3)


def test_scales_are_inverse_roots_of_the_curvature_bound(spark):
    model = linear.fit(labeled(spark), [], c=2.0, max_iter=0)
    terms, x, y, c = dense(model)
    found = {r["term"]: r for r in linear._at_zero(model.rows, linear.LOSSES["logistic"], 0.5).collect()}
    scale = 1 / np.sqrt((c[:, None] * x * x).sum(axis=0) / 4 + 0.5)
    assert np.allclose([found[t]["scale"] for t in [*terms, linear.INTERCEPT]], scale)
    gradient = x.T @ (c * (0.5 - y))
    assert np.allclose([found[t]["g"] for t in [*terms, linear.INTERCEPT]], gradient * scale)
    assert model.start == model.end == pytest.approx(np.linalg.norm(gradient))


def test_scores_follow_the_parameters(spark):
    rows = labeled(spark)
    model = linear.fit(rows, [], max_iter=3)
    terms, x, _, _ = dense(model)
    z = x @ parameters(model, terms)
    found = linear.score(model, rows).orderBy("doc_id", "sentence_id").collect()
    assert np.allclose([r["score"] for r in found], 1 / (1 + np.exp(-z)))
    assert [r["prediction"] for r in found] == [int(v > 0) for v in z]
    unseen = linear.score(model, spark.createDataFrame([(1, 1, "unheard")], "doc_id long, sentence_id int, sentence string"))
    assert unseen.first()["score"] == pytest.approx(1 / (1 + math.exp(-model.intercept)))


def test_no_whole_row_is_shuffled(spark):
    model = linear.fit(labeled(spark), [], max_iter=1)
    slopes = model.rows.select(*linear.KEY, F.lit(1.0).alias("r"))
    plan = linear._slopes_per_term(model.rows, slopes)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning(doc_id" in line]
    assert not exchanges


def test_odd_input(spark):
    with pytest.raises(ValueError, match="both classes"):
        linear.fit(labeled(spark).withColumn("label", F.lit(1)), [])
    with pytest.raises(ValueError, match="rows"):
        linear.fit(labeled(spark).where("doc_id < 0"), [], "squared")
    wordless = linear.fit(labeled(spark).where("doc_id >= 10000"), [], tolerance=1e-6)
    assert wordless.terms.count() == 0 and wordless.intercept == pytest.approx(0, abs=1e-6)
