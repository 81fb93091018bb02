"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the words in it and of
the beginnings of words (offences are inflected and compounded); the document's score is the noisy-or of its sentences, 1 - prod(1 - p). Only document labels are needed for
training; afterwards the sentence scores show where the offence is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from precis.llm.common import map_arrow, written

_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_LONGEST_WORD = 40  # a longer run of letters is looked up by its first characters and its length
_BEGINNINGS = range(3, 8)
_CACHED_WORDS = 200_000


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds the labelled rows that the model is fitted on (in expectation: rows are drawn
    by a hash of the text). ``vocabulary`` bounds its features: those whose document counts differ
    most between the classes, each in at least ``least`` rows of the sample."""

    fit_rows: int = 20_000
    vocabulary: int = 4096
    least: int = 3
    steps: int = 300
    rate: float = 0.3
    decay: float = 1e-4


def features(word: str) -> list[str]:
    """The word and, with a mark, its beginnings."""
    whole = word if len(word) <= _LONGEST_WORD else f"{word[:_LONGEST_WORD]}{len(word)}"
    return [whole, *(f"{word[:k]}-" for k in _BEGINNINGS if k < len(word))]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and lower-cased words of each sentence of the whole text."""
    for found in _SENTENCE.finditer(text):
        yield found.start(), found.end(), set(_WORD.findall(found.group().lower()))


class Cache(dict):
    """Word to what ``make`` says of it; emptied when it is full."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= _CACHED_WORDS:
            self.clear()
        self[word] = made = self.make(word)
        return made


@dataclass(frozen=True)
class Model:
    """Weights of features, the weight of a sentence as such (``bias``) and the share of label 1."""

    weights: dict[str, float]
    bias: float
    prior: float

    def word_features(self) -> Cache:
        """For each word its features in the vocabulary."""
        return Cache(lambda word: [f for f in features(word) if f in self.weights])

    def score(self, text: str, known: Cache) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of a text and those of its sentences that have a feature of the vocabulary."""
        scored, survive = [], 1.0
        for start, end, words in sentences(text):
            found = {f for word in words for f in known[word]}
            if found:
                p = 1 / (1 + math.exp(-max(-500.0, self.bias + sum(map(self.weights.__getitem__, sorted(found))))))
                scored.append((start, end, p))
                survive *= 1 - p
        return min(1.0, max(0.0, 1 - survive)), scored


def _fit_bags(bags: list[list[list[int]]], labels: np.ndarray, n: int, s: Settings) -> tuple[np.ndarray, float]:
    """Full-batch gradient steps (Adam) on the log loss of the noisy-or."""
    doc_of, sent_of, word_of = [], [], []
    n_sentences = 0
    for doc, bag in enumerate(bags):
        for sentence in bag:
            doc_of.append(doc)
            sent_of += [n_sentences] * len(sentence)
            word_of += sentence
            n_sentences += 1
    doc_of, sent_of, word_of = (np.array(x, dtype=np.int64) for x in (doc_of, sent_of, word_of))
    theta = np.zeros(n + 1)
    theta[n] = -3.0
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    y = labels.astype(float)
    for step in range(1, s.steps + 1):
        z = theta[n] + np.bincount(sent_of, theta[word_of], n_sentences)
        log_survive = -np.logaddexp(0, z)  # log(1 - p)
        total = np.bincount(doc_of, log_survive, len(bags))
        p_doc = np.clip(-np.expm1(total), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence = -(y - p_doc) / p_doc * p_sentence
        pull = -((y - p_doc) / p_doc)[doc_of] / (1 + np.exp(-z)) / len(bags)
        grad = np.append(np.bincount(word_of, pull[sent_of], n), pull.sum())
        grad[:n] += s.decay * theta[:n]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta -= s.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return theta[:n], float(theta[n])


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, settings: Settings = Settings(),
          doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit the model on the labelled rows where ``may_learn`` (on ``doc_id``) holds.

    Words are counted per class by a Spark aggregation; the bounded sample of bags is then fitted in one
    task. A document with several label rows takes the highest. Without labelled rows, or with one class
    only, the vocabulary is empty and every score is the share of label 1 (0 if there is none).
    """
    s = settings
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & may_learn)
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    n_known = known.count()
    if not n_known:
        return Model({}, -30.0, 0.0)
    share = min(1.0, s.fit_rows / n_known)
    known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    sample = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = written(sample.join(known, "id").select("text", "y"), "labelled-sample")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: dict[str, list[int]] = {}
            for value, y in zip(frame["text"], frame["y"], strict=True):
                for feature in {f for w in set(_WORD.findall(value.lower())) for f in features(w)}:
                    counts.setdefault(feature, [0, 0])[y > 0] += 1
            if counts:
                n0, n1 = zip(*counts.values(), strict=True)
                yield pd.DataFrame({"word": list(counts), "n0": n0, "n1": n1})

    sizes = {r["y"]: r["n"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    prior = n1 / max(1, n0 + n1)
    if not n0 or not n1:
        return Model({}, -30.0 if not n1 else 30.0, prior)
    counted = sample.mapInPandas(count, "word string, n0 long, n1 long")
    counted = counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rate0, rate1 = F.col("n0") / n0, F.col("n1") / n1
    pooled = (F.col("n0") + F.col("n1")) / (n0 + n1)
    spread = F.abs(rate1 - rate0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1) + 1e-12)
    words = [r["word"] for r in counted.filter(F.col("n0") + F.col("n1") >= s.least)
             .orderBy(spread.desc(), "word").limit(s.vocabulary).select("word").collect()]
    index = {w: i for i, w in enumerate(words)}

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bags, labels = [], []
        for frame in frames:
            for bag, y in zip(frame["bag"], frame["y"], strict=True):
                bags.append([list(x) for x in bag])
                labels.append(y)
        weights, bias = _fit_bags(bags, np.array(labels), len(words), s)
        yield pd.DataFrame({"word": [*words, None], "weight": [*weights, bias]})

    def bag_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Cache(lambda word: [index[f] for f in features(word) if f in index])
        for frame in frames:
            bags = []
            for value in frame["text"]:
                found = ({i for w in ws for i in known[w]} for _, _, ws in sentences(value))
                bags.append([sorted(x) for x in found if x])
            yield pd.DataFrame({"y": (frame["y"] > 0).astype("int64"), "bag": bags})

    bags = sample.mapInPandas(bag_up, "y long, bag array<array<int>>")
    rows = bags.orderBy("y", "bag").coalesce(1).mapInPandas(fit, "word string, weight double").collect()
    weights = {r["word"]: r["weight"] for r in rows if r["word"] is not None}
    bias = next(r["weight"] for r in rows if r["word"] is None)
    return Model(weights, bias, prior)


FIELDS = [
    T.StructField("score", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()),
    T.StructField("offending", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]))),
]


def score(docs: DataFrame, model: Model, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``score``, ``predicted`` and the ``offending`` sentences (code-point spans that score at least 0.5)
    of every whole text, beside the columns in ``keep``.

    A null or empty text has no sentence and scores 0, like a text without any feature of the vocabulary.
    Repeated rows are each scored; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        model = shared.value
        known = model.word_features()

        def one(value: str | None) -> tuple:
            p, scored = (model.score(value or "", known) if model.weights else (model.prior, []))
            spans = [{"start": a, "end": b, "score": float(q)} for a, b, q in scored if q >= 0.5]
            return p, int(p >= 0.5), spans

        return lambda columns: list(zip(*(one(t.as_py()) for t in columns[0]), strict=True))

    return map_arrow(docs, [text, *keep], FIELDS, compute, inputs=1)
