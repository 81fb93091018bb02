"""Linear models over TF-IDF terms whose parameters are a table, one row per term.

No vocabulary and no parameter vector is gathered: a margin is a join with the parameters and a sum per
row, a gradient is a sum per term. Steps are L-BFGS in the form that needs only the inner products of
its basis vectors (Chen et al. 2014): these vectors are columns of the parameter table, one aggregate gives all products,
and the next direction is a linear combination of the columns. The table holds each parameter divided by
its ``scale``, the inverse root of a bound of its curvature: else the intercept, which every row has,
would set the number of steps. Along a direction margins are linear, so
one scan of two numbers per row compares all step lengths.

Every step is four jobs whatever the number of terms and rows. The rows are bucketed by their key, so
that a step shuffles sums per row and per term, and whole rows never.

Up to ``MOST_PARAMETERS`` terms the same steps are taken on numbered rows: every task holds the parameters, and a step is
one pass for the step length and one for the gradient, of which each task hands on one partial sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis import fixed_values as fixed
from precis.functions import lookup, margins as numbered_margins, network, text
from precis.operators import features, lookups, models
from precis.sources import store

KEY = features.ROW_KEY
INTERCEPT = ""  # term of the intercept; no token is empty
MOST_PARAMETERS = 1 << 22  # of a model that every task holds; the search keeps thirteen numbers for each
_MEMORY = 5
_STEPS = [2.0**k for k in range(6, -15, -1)]


@dataclass(frozen=True)
class Loss:
    """A loss of margin and 0/1 label, its slope in the margin and the bound of its second derivative."""

    value: Callable[[Column, Column], Column]
    slope: Callable[[Column, Column], Column]
    value_of: Callable[[np.ndarray, np.ndarray], np.ndarray]  # the same two for arrays
    slope_of: Callable[[np.ndarray, np.ndarray], np.ndarray]
    curvature: float
    balanced: bool  # classes weigh the same in total
    penalized_intercept: bool


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _log_loss(z: Column, label: Column) -> Column:
    signed = F.when(label == 1, z).otherwise(-z)
    return F.log1p(F.exp(-F.abs(signed))) + F.greatest(-signed, F.lit(0.0))


LOSSES = {
    "logistic": Loss(
        _log_loss, lambda z, label: _sigmoid(z) - label, numbered_margins.log_loss, numbered_margins.log_slope, 0.25, True, True
    ),
    "squared": Loss(
        lambda z, label: (z - label) * (z - label) / 2, lambda z, label: z - label,
        numbered_margins.squared_loss, numbered_margins.squared_slope, 1.0, False, False,
    ),
}


@dataclass(frozen=True)
class LinearModel:
    """``terms`` holds ``(term, idf, w)``; ``rows`` are the weighted training rows the fit has read.

    ``start`` and ``end`` are the lengths of the gradient before the first and after the last step.
    """

    loss: str
    penalty: float
    terms: DataFrame
    intercept: float
    rows: DataFrame
    stop_words: list[str]
    n_steps: int
    start: float
    end: float
    unique: bool = False  # no two rows have one key


def weighted_rows(labeled: DataFrame, stop_words: list[str], balanced: bool) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, sentence_id, label, c, terms)`` and ``(term, idf)`` of the given rows, both written.

    ``terms`` has the unit-length TF-IDF values of a row and is empty where it has no term. ``c`` is the
    weight of the row. Keys must be unique.
    """
    counted = store.staged(
        features.with_term_counts(labeled, "sentence", stop_words).select(*KEY, "label", "terms"), "term-counts"
    )
    idf = store.staged(features.fit_idf(counted).select("term", "idf"), "idf")
    if balanced:
        counted = models.with_class_weight(counted).withColumnRenamed("weight", "c")
    else:
        counted = counted.withColumn("c", F.lit(1.0))
    known = lookups.shared(idf, "idf")
    if known is not None and _unique(counted):
        @F.arrow_udf("array<struct<term: string, x: double>>")
        def weighted(terms: pa.Array) -> pa.Array:
            return lookup.weighted(terms, *known.value)

        return store.bucketed(counted.withColumn("terms", weighted("terms")).select(*KEY, "label", "c", "terms"), "rows", *KEY), idf
    gathered = features.weights(counted, idf).groupBy(*KEY).agg(
        F.collect_list(F.struct("term", F.col("weight").alias("x"))).alias("terms")
    )
    nothing = F.array().cast("array<struct<term:string,x:double>>")
    rows = counted.drop("terms").join(gathered, list(KEY), "left").withColumn("terms", F.coalesce("terms", nothing))
    return store.bucketed(rows, "rows", *KEY), idf


def _unique(rows: DataFrame) -> bool:
    return rows.groupBy(*KEY).count().where("count > 1").isEmpty()


def _numbered(rows: DataFrame, terms: DataFrame, *values: str) -> tuple[DataFrame, Broadcast] | None:
    """Written rows ``label, c, at, x`` and the numbered terms with their ``values``; None if there are too many."""
    if terms.count() > MOST_PARAMETERS or (known := lookups.shared(terms, *values)) is None:
        return None

    @F.arrow_udf("at array<int>, x array<double>")
    def places(terms: pa.Array) -> pa.Array:
        return numbered_margins.numbered(terms, known.value[0])

    found = rows.select("label", "c", places("terms").alias("_t")).select("label", "c", "_t.*")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return store.staged(found, "numbered").coalesce(cores), known


def _summed_chunks(rows: DataFrame, parameters: np.ndarray, *how) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast(parameters)
    kind = "at int, part array<double>"
    parts = rows.mapInArrow(numbered_margins.gradients(shared, *how), kind)
    found = parts.groupBy("at").applyInArrow(network.chunk_sum, kind).toArrow().sort_by("at")
    shared.destroy()
    return found["part"].combine_chunks().flatten().to_numpy()


def _penalties(size: int, penalty: float, loss: Loss) -> np.ndarray:
    found = np.full(size, penalty)
    if not loss.penalized_intercept:
        found[-1] = 0.0
    return found


def _step_of_numbered(rows: DataFrame, w: np.ndarray, d: np.ndarray, penalty: np.ndarray, loss: Loss) -> float | None:
    """:func:`_best_step` for parameters and direction as arrays."""
    steps = [0.0, *_STEPS]
    shared = rows.sparkSession.sparkContext.broadcast((w, d))
    found = rows.mapInArrow(numbered_margins.losses(shared, steps, loss.value_of), "at int, total double").groupBy("at").agg(
        F.sum("total").alias("total")
    ).collect()
    shared.destroy()
    ww, wd, dd = penalty @ (w * w), penalty @ (w * d), penalty @ (d * d)
    values = {steps[r["at"]]: r["total"] + ww / 2 + steps[r["at"]] * wd + steps[r["at"]] ** 2 * dd / 2 for r in found}
    best = min(_STEPS, key=values.get)
    return best if values[best] < values[0.0] else None


def _fit_numbered(
    rows: DataFrame, size: int, loss: Loss, penalty: float, max_iter: int, tolerance: float
) -> tuple[np.ndarray, int, float, float]:
    """The parameters, steps and lengths of the gradient: the steps of :func:`fit` with arrays in place of columns."""
    penalties = _penalties(size, penalty, loss)
    first = _summed_chunks(rows, np.zeros(size), loss.slope_of, loss.curvature)
    scale = 1.0 / np.sqrt(first[size:] + penalties)
    w, g = np.zeros(size), first[:size] * scale
    s, y, steps, start = [], [], 0, float(np.linalg.norm(first[:size]))
    length = start
    while length > tolerance * start and steps < max_iter:
        basis = [*s, *y, g]
        coefficients = direction(np.array([[a @ b for b in basis] for a in basis]), len(s))
        d = sum(a * b for a, b in zip(coefficients, basis))
        step = _step_of_numbered(rows, w * scale, d * scale, penalties, loss)
        if step is None:
            break
        w = w + step * d
        after = _summed_chunks(rows, w * scale, loss.slope_of) * scale + scale * scale * penalties * w
        s, y = [*s, step * d][-_MEMORY:], [*y, after - g][-_MEMORY:]
        g, steps = after, steps + 1
        length = float(np.linalg.norm(g / scale))
    return w * scale, steps, start, length


def _entries(rows: DataFrame, *carry: str) -> DataFrame:
    """One row per term; a row without terms has a placeholder that is no term and differs by document."""
    found = rows.select(*KEY, *carry, F.explode_outer(text.whole(F.col("terms"))).alias("_t"))
    placeholder = F.concat(F.lit("#"), F.col("doc_id").cast("string"))
    return found.select(
        *KEY, *carry, F.coalesce("_t.term", placeholder).alias("term"), F.coalesce("_t.x", F.lit(0.0)).alias("x")
    )


def _margins(rows: DataFrame, parameters: DataFrame, intercepts: dict[str, float]) -> DataFrame:
    """``(key, label, c)`` and a margin per column of ``intercepts``, which are columns of ``parameters``."""
    joined = _entries(rows, "label", "c").join(parameters, "term", "left")
    sums = [
        (F.coalesce(F.sum(F.col("x") * F.col(name)), F.lit(0.0)) + F.lit(b)).alias(name) for name, b in intercepts.items()
    ]
    return joined.groupBy(*KEY).agg(F.first("label").alias("label"), F.first("c").alias("c"), *sums)


def _slopes_per_term(rows: DataFrame, slopes: DataFrame) -> DataFrame:
    """``(term, part)``: the gradient of the summed losses, given each row's ``r``."""
    entries = _entries(rows.select(*KEY, "terms").join(slopes.select(*KEY, "r"), list(KEY)), "r")
    known = entries.where(~F.startswith(F.col("term"), F.lit("#")))
    sums = known.groupBy("term").agg(F.sum(F.col("r") * F.col("x")).alias("part"))
    return sums.unionByName(slopes.agg(F.sum("r").alias("part")).select(F.lit(INTERCEPT).alias("term"), "part"))


def _at_zero(rows: DataFrame, loss: Loss, penalty: float) -> DataFrame:
    """``(term, scale, w, g)``: all parameters zero, and the gradient in the scaled parameters there."""
    slope, bound = F.col("c") * loss.slope(F.lit(0.0), F.col("label")), F.col("c") * loss.curvature
    entries = _entries(rows.select(*KEY, "terms", slope.alias("r"), bound.alias("h")), "r", "h")
    known = entries.where(~F.startswith(F.col("term"), F.lit("#")))
    sums = known.groupBy("term").agg(
        F.sum(F.col("r") * F.col("x")).alias("part"), F.sum(F.col("h") * F.col("x") * F.col("x")).alias("h")
    )
    last = rows.agg(F.sum(slope).alias("part"), F.sum(bound).alias("h"))
    both = sums.unionByName(last.select(F.lit(INTERCEPT).alias("term"), "part", "h"))
    both = both.withColumn("scale", 1 / F.sqrt(F.col("h") + _penalized(both, penalty, loss)))
    return both.select("term", "scale", F.lit(0.0).alias("w"), (F.col("part") * F.col("scale")).alias("g"))


def _penalized(parameters: DataFrame, penalty: float, loss: Loss) -> Column:
    """The penalty of a row of the parameter table, 0 for an intercept that is free."""
    free = (F.col("term") == INTERCEPT) & F.lit(not loss.penalized_intercept)
    return F.when(free, F.lit(0.0)).otherwise(F.lit(penalty))


def _products(state: DataFrame, columns: list[str], share: Column) -> tuple[np.ndarray, dict[str, float], np.ndarray, float]:
    """Inner products of all columns, the intercept's unscaled value of each, the products under the
    penalty, and the length of the unscaled gradient ``g``.

    A batch of terms becomes one small matrix product, so each task hands on a few sums per batch.
    """
    n, g = len(columns), columns.index("g")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(i).to_numpy() for i in range(n)])
            shares, scale = batch.column(n).to_numpy(), batch.column(n + 1).to_numpy()
            last = batch.column(n + 2).to_numpy(zero_copy_only=False)
            slopes = values[:, g] / scale
            parts = (
                values.T @ values, values.T @ (values * shares[:, None]), (values[last] * scale[last, None]).sum(axis=0),
                slopes @ slopes,
            )
            flat = np.concatenate([np.ravel(p) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["at", "part"])

    rows = state.select(*columns, share.alias("_share"), "scale", (F.col("term") == INTERCEPT).alias("_last"))
    found = rows.mapInArrow(summed, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    flat = np.zeros(2 * n * n + n + 1)
    for r in found:
        flat[r["at"]] = r["part"]
    plain, under, last, length = np.split(flat, [n * n, 2 * n * n, 2 * n * n + n])
    return plain.reshape(n, n), dict(zip(columns, last.tolist(), strict=True)), under.reshape(n, n), math.sqrt(length[0])


def direction(gram: np.ndarray, k: int) -> np.ndarray:
    """Coefficients of the L-BFGS direction over ``s1..sk, y1..yk, g`` (oldest first) from their inner products."""
    coefficients = np.zeros(2 * k + 1)
    coefficients[2 * k] = -1.0
    if k == 0:
        return coefficients / math.sqrt(gram[0, 0])
    curvature = [gram[i, k + i] for i in range(k)]
    alpha = [0.0] * k
    for i in reversed(range(k)):
        alpha[i] = coefficients @ gram[:, i] / curvature[i]
        coefficients[k + i] -= alpha[i]
    coefficients *= curvature[-1] / gram[2 * k - 1, 2 * k - 1]
    for i in range(k):
        coefficients[i] += alpha[i] - coefficients @ gram[:, k + i] / curvature[i]
    return coefficients


def _best_step(margins: DataFrame, loss: Loss, ww: float, wd: float, dd: float) -> float | None:
    """The step length of the least objective, None if no step lowers it. ``ww``, ``wd`` and ``dd`` are penalties."""
    tried = margins.select("w", "d", "label", "c", F.explode(F.array(*map(F.lit, [0.0, *_STEPS]))).alias("t"))
    z = F.col("w") + F.col("t") * F.col("d")
    found = tried.groupBy("t").agg(F.sum(F.col("c") * loss.value(z, F.col("label"))).alias("total")).collect()
    values = {r["t"]: r["total"] + ww / 2 + r["t"] * wd + r["t"] ** 2 * dd / 2 for r in found}
    best = min(_STEPS, key=values.get)
    return best if values[best] < values[0.0] else None


def fit(
    labeled: DataFrame, stop_words: list[str], loss: str = "logistic", c: float = 1.0,
    max_iter: int = 1000, tolerance: float = 1e-3,
) -> LinearModel:
    """Least ``|w|^2 / (2 c)`` plus the summed losses, over all rows of ``(doc_id, sentence_id, sentence, label)``.

    ``c`` of infinity leaves the penalty out. Ends when the gradient is ``tolerance`` times its length at
    zero, when no step lowers the objective, or after ``max_iter`` steps. One class only is a ``ValueError``
    for the logistic loss, no row one for both.
    """
    kind, penalty = LOSSES[loss], 1.0 / c
    rows, idf = weighted_rows(labeled, stop_words, kind.balanced)
    if rows.isEmpty():
        raise ValueError("training needs rows")
    unique = _unique(rows)
    if unique and (found := _numbered(rows, idf, "idf")) is not None:
        places, known = found
        fitted, steps, start, length = _fit_numbered(places, len(known.value[0]) + 1, kind, penalty, max_iter, tolerance)
        shared = rows.sparkSession.sparkContext.broadcast(fitted)

        @F.arrow_udf("double")
        def parameter(terms: pa.Array) -> pa.Array:
            return pa.array(shared.value[lookup.places(known.value[0], terms)])

        terms = store.staged(idf.select("term", parameter("term").alias("w"), "idf"), "parameters")
        return LinearModel(loss, penalty, terms, float(fitted[-1]), rows, stop_words, steps, start, length, unique)
    state = store.staged(_at_zero(rows, kind, penalty), "parameters")
    share = F.col("scale") * F.col("scale") * _penalized(state, penalty, kind)
    k = steps = 0
    start = None
    while True:
        basis = [f"s{i}" for i in range(k)] + [f"y{i}" for i in range(k)] + ["g"]
        gram, at, shares, length = _products(state, [*basis, "w"], share)
        start = length if start is None else start
        if length <= tolerance * start or steps == max_iter:
            break
        coefficients = direction(gram[:-1, :-1], k)
        d = sum((F.lit(float(a)) * F.col(n) for a, n in zip(coefficients, basis)), F.lit(0.0))
        b = float(sum(a * at[n] for a, n in zip(coefficients, basis)))
        margins = store.staged(
            _margins(
                rows, state.select("term", *[(v * F.col("scale")).alias(n) for n, v in (("w", F.col("w")), ("d", d))]),
                {"w": at["w"], "d": b},
            ), "margins"
        )
        inner = shares[:-1, :-1]
        step = _best_step(
            margins, kind, shares[-1, -1], float(coefficients @ shares[:-1, -1]), float(coefficients @ inner @ coefficients)
        )
        if step is None:
            break
        z = F.col("w") + F.lit(step) * F.col("d")
        slopes = margins.select(*KEY, (F.col("c") * kind.slope(z, F.col("label"))).alias("r"))
        moved = state.withColumn("_s", F.lit(step) * d).join(_slopes_per_term(rows, slopes), "term", "left")
        w = F.col("w") + F.col("_s")
        g = F.coalesce("part", F.lit(0.0)) * F.col("scale") + share * w
        first = 1 if k == _MEMORY else 0
        kept = [f"{v}{i}" for v in "sy" for i in range(first, k)]
        k = k - first + 1
        state = store.staged(moved.select(
            "term", "scale", w.alias("w"), g.alias("g"),
            *[F.col(name).alias(f"{name[0]}{int(name[1:]) - first}") for name in kept],
            F.col("_s").alias(f"s{k - 1}"), (g - F.col("g")).alias(f"y{k - 1}"),
        ), "parameters")
        steps += 1
    return LinearModel(
        loss, penalty, state.select("term", (F.col("w") * F.col("scale")).alias("w")).join(idf, "term"), at["w"], rows, stop_words, steps, start, length, unique
    )


def gradient_length(model: LinearModel) -> float:
    """Length of the gradient at the model, from its parameters and the training rows alone."""
    kind = LOSSES[model.loss]
    if model.unique and (found := _numbered(model.rows, model.terms, "w")) is not None:
        places, known = found
        w = np.append(known.value[1], model.intercept)
        return float(np.linalg.norm(_summed_chunks(places, w, kind.slope_of) + _penalties(len(w), model.penalty, kind) * w))
    found = _margins(model.rows, model.terms.select("term", "w"), {"w": model.intercept})
    slopes = store.staged(
        found.select(*KEY, (F.col("c") * kind.slope(F.col("w"), F.col("label"))).alias("r")), "slopes"
    )
    w = F.when(F.col("term") == INTERCEPT, F.lit(model.intercept)).otherwise(F.coalesce("w", F.lit(0.0)))
    parts = _slopes_per_term(model.rows, slopes).join(model.terms.select("term", "w"), "term", "left")
    g = F.col("part") + _penalized(parts, model.penalty, kind) * w
    return parts.agg(F.sqrt(F.sum(g * g))).first()[0]


def score(model: LinearModel, sentences: DataFrame) -> DataFrame:
    """``(doc_id, sentence_id, score, prediction)``; a sentence without known terms has the intercept alone.

    The score is the probability of label 1 for the logistic loss, the fitted value for the squared one.
    """
    counted = features.with_term_counts(sentences, "sentence", model.stop_words)
    sums = lookups.row_sums(counted, model.terms, "w").groupBy(*KEY).agg(
        F.sum("_s").alias("_sum"), F.sqrt(F.sum("_q")).alias("_norm")
    )
    z = F.when(F.col("_norm") > 0, F.col("_sum") / F.col("_norm")).otherwise(F.lit(0.0)) + F.lit(model.intercept)
    if model.loss == "logistic":
        return sums.select(*KEY, _sigmoid(z).alias("score"), (z > 0).cast("int").alias("prediction"))
    return sums.select(*KEY, z.alias("score"), (z >= fixed.LINREG_THRESHOLD).cast("int").alias("prediction"))
