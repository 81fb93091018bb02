"""Golden rows, brute-force checks and properties of the operators."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from precis.functions import lcs
from precis.operators import (
    chat, evaluation, features, labels, naive_bayes, ranking, rouge, sequences, splits, summaries,
    transcripts,
)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_equals_dynamic_program():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randrange(90))]
        b = [rng.choice("abcdefg") for _ in range(rng.randrange(90))]
        assert lcs.lcs_length(a, b) == plain_lcs(a, b)


def score(spark, candidate, reference, stem=False):
    df = spark.createDataFrame([(candidate, reference)], "text string, reference string")
    return rouge.score_pairs(df, stem=stem).first()


def test_rouge_golden(spark):
    got = score(spark, "the cat on the mat", "the cat sat on the mat")
    assert tuple(got["rouge1"]) == pytest.approx((1, 5 / 6, 10 / 11))
    assert tuple(got["rouge2"]) == pytest.approx((0.75, 0.6, 2 / 3))
    assert tuple(got["rougeL"]) == pytest.approx((1, 5 / 6, 10 / 11))
    assert tuple(score(spark, "a a a", "a a b")["rouge1"]) == pytest.approx((2 / 3,) * 3)
    assert tuple(score(spark, "", "a b")["rouge1"]) == (0, 0, 0)
    assert score(spark, "cats hopping", "cat hops")["rouge1"]["f"] == 0
    assert score(spark, "cats hopping", "cat hop", stem=True)["rougeL"]["f"] == 1
    assert score(spark, "horses hopping", "horse hopped", stem=True)["rougeL"]["f"] == 1


def test_rouge_equals_brute_force(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randrange(30)))
    pairs = [(text(), text()) for _ in range(60)]
    df = spark.createDataFrame(pairs, "text string, reference string")
    for row in rouge.score_pairs(df, stem=False).collect():
        c, r = row["text"].split(), row["reference"].split()
        grams = lambda ts, n: Counter(zip(*[ts[i:] for i in range(n)]))
        hits = {
            "rouge1": sum((grams(c, 1) & grams(r, 1)).values()),
            "rouge2": sum((grams(c, 2) & grams(r, 2)).values()),
            "rougeL": plain_lcs(c, r),
        }
        for metric, hit in hits.items():
            less = 1 if metric == "rouge2" else 0
            n, m = max(len(c) - less, 0), max(len(r) - less, 0)
            p, q = hit / n if n else 0, hit / m if m else 0
            f = 2 * p * q / (p + q) if p + q else 0
            assert tuple(row[metric]) == pytest.approx((p, q, f))
            assert 0 <= row[metric]["f"] <= 1


SCORES = [0.2, 0.5, 0.5, 0.1, 0.5, 0.0]


@pytest.mark.parametrize("scores, k, ties, expected", [
    (SCORES, 2, "first", {1, 2}),
    (SCORES, 2, "last", {2, 4}),
    ([0.0] * 6, 5, "first", {0, 1, 2, 3, 4}),
    ([0.3, 0.2, 0.1], 5, "first", {0, 1, 2}),
])
def test_top_k(spark, scores, k, ties, expected):
    df = spark.createDataFrame([(7, i, s) for i, s in enumerate(scores)], "doc_id long, sentence_id int, score double")
    marked = ranking.with_top_k(df, k, ties=ties)
    assert {r["sentence_id"] for r in marked.collect() if r["label"]} == expected
    assert {r["sentence_id"] for r in ranking.top_k(df, k, ties=ties).collect()} == expected
    if ties == "first":
        row = spark.createDataFrame([(scores,)], "s array<double>")
        assert set(row.select(ranking.top_k_of_array(F.col("s"), k)).first()[0]) == expected


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select(
        (F.col("id") % 3).alias("doc_id"), F.col("id").cast("int").alias("sentence_id"), F.rand(1).alias("score")
    )
    plan = ranking.top_k(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_overlap_labels(spark):
    text = "The cat sat. A dog ran far away. The cat sat on the mat. Nothing else matters here now. Birds sing. Fish swim."
    pairs = spark.createDataFrame([(1, text, "the cat sat on the mat"), (2, "  ", "x")], "doc_id long, document string, summary string")
    rows = labels.label_by_overlap(pairs, k=2, stem=False).collect()
    assert {r["doc_id"] for r in rows} == {1}
    assert [r["sentence_id"] for r in rows if r["label"]] == [0, 2]
    assert rows[2]["score"] == 1.0
    assert labels.label_by_overlap(pairs, k=2, cap=2, stem=False).count() == 2


def test_null_texts_count_as_empty(spark):
    schema = "doc_id long, document string, summary string"
    pairs = spark.createDataFrame([(1, None, "x"), (2, "One here. Two there.", None), (3, "A b.", "a b")], schema)
    for stem in (False, True):
        rows = {(r["doc_id"], r["sentence_id"]): r["score"] for r in labels.label_by_overlap(pairs, stem=stem).collect()}
        assert rows == {(2, 0): 0.0, (2, 1): 0.0, (3, 0): 1.0}
        candidates = spark.createDataFrame([("s", 3, None), ("s", 2, "x")], "system string, doc_id long, text string")
        scored = rouge.score_systems(candidates, pairs.select("doc_id", "summary"), stem=stem).collect()
        assert {r["doc_id"] for r in scored} == {2, 3}
        assert all(tuple(r[m]) == (0, 0, 0) for r in scored for m in rouge.METRICS)


def test_no_positives(spark):
    df = spark.createDataFrame([(0,), (0,)], "label int")
    assert labels.positive_weight(df).first()[0] is None


def test_first_of_copies_without_broadcast(spark):
    df = spark.createDataFrame([(i, f"t{i % 50}") for i in range(500)], "doc_id long, transcript string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r["doc_id"] for r in transcripts.first_of_copies(df).collect()} == set(range(50))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# One name for each keyword of the published rules, written down apart from the product's list.
TOPIC_NAMES = {
    "NLP": ["Natural Language Processing", "intro nlp", "The Transformer", "BERT talks", "spaCy", "Hugging Face"],
    "RL": ["Reinforcement Learning", "Deep RL course", "rl - talks"],
    "ML/Deep Learning": [
        "Machine Learning", "Deep Learning", "Neural Network", "CS229", "CS230", "CS221", "CS234", "ML Tech Talks",
        "MIT Advanced Machine Learning", "Advanced Deep Learning", "Deep Learning Course", "Deep Learning Basics",
        "Practical Deep Learning", "Deep Learning Fundamentals", "Intro to Deep Learning",
        "Deep Learning from the Foundations", "Deep Learning Research Papers",
    ],
    "AI: General/Papers": [
        "Artificial Intelligence", "AI talks", "AI-news", "AI, today", "AI: a start", "Age of A.I.",
        "Two Minute Papers", "Papers Explained", "AI Explained", "Cognitive and AI",
    ],
    "DS/Stats": [
        "Data Science", "PyData", "SciPy", "Tabular Data", "Practical Statistics", "Data Engineering",
        "Linear Algebra", "Data Analysis", "Pandas Tutorial", "Free Data Science Course", "Python Data Analysis",
    ],
    "Programming/Python": [
        "Python", "Django", "Flask", "PyTorch", "TensorFlow", "Matplotlib", "Modules and Libraries", "Projects",
        "Programming", "Web Scraping", "Beautiful Soup",
    ],
    "Podcast/Talk": ["Podcast", "DeepMind: The Podcast", "Lex Fridman", "Our Story"],
    "Other": ["Gardening", None],
}


def test_every_topic_keyword(spark):
    rows = [(n, t) for t, names in TOPIC_NAMES.items() for n in names]
    df = spark.createDataFrame(rows, "playlist_name string, expected string")
    wrong = transcripts.with_topic(df).where("topic <> expected").collect()
    assert wrong == []


def test_first_of_copies(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (9, "z"), (5, "z")], "doc_id long, transcript string")
    assert {r["doc_id"] for r in transcripts.first_of_copies(df).collect()} == {1, 2, 5}


def test_missing_transcripts(spark):
    df = spark.createDataFrame([(1, None), (2, "  \n"), (3, "ok")], "doc_id long, transcript string")
    assert [r["doc_id"] for r in transcripts.drop_missing(df).collect()] == [3]


def test_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    got = {r["label"]: r["weight"] for r in transcripts.balanced_weights(df, "label").collect()}
    assert got == pytest.approx({1: 2.0, 0: 2 / 3})
    assert labels.positive_weight(df).first()[0] == 3.0


def test_tfidf(spark):
    df = spark.createDataFrame([(1, 0, "aa bb aa"), (1, 1, "bb cc"), (1, 2, "cc dd"), (1, 3, "!")], "doc_id long, sentence_id int, sentence string")
    counted = features.with_term_counts(df.where("sentence_id < 3"), "sentence", [])
    idf = features.fit_idf(counted)
    first = {r["term"]: r["weight"] for r in features.weights(counted, idf).where("sentence_id = 0").collect()}
    assert first == pytest.approx({"aa": 0.9347, "bb": 0.3554}, abs=1e-4)
    assert {r["term"] for r in features.most_frequent(features.term_stats(counted), 3).collect()} == {"aa", "bb", "cc"}


def test_cosine(spark):
    docs = spark.createDataFrame([(1, ["green apples fall", "dogs bark", "zz"], "green apples fall")], "doc_id long, sentences array<string>, summary string")
    idf = labels.fit_summary_idf(docs, [], max_features=8)
    scores = {r["sentence_id"]: r["score"] for r in labels.cosine_scores(docs, idf, []).collect()}
    assert scores[0] == pytest.approx(1)
    assert scores[1] == 0 and scores[2] == 0
    once = {r["term"]: r["df"] for r in labels.fit_summary_idf(docs, [], summary_once=True).collect()}
    each = {r["term"]: r["df"] for r in labels.fit_summary_idf(docs, []).collect()}
    assert (once["green"], each["green"]) == (2, 4)


def test_hand_labels(spark):
    notes = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x")], "file_name string, sentence_id int, sentence string")
    listed = spark.createDataFrame([("a", "x"), ("a", "x")], "file_name string, sentence string")
    got = {(r["file_name"], r["sentence_id"]): r["label"] for r in labels.label_by_hand(notes, listed).collect()}
    assert got == {("a", 0): 1, ("a", 1): 0, ("b", 0): 0}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 137])
def test_split_documents(spark, n):
    rows = splits.split_documents(spark.range(n).withColumnRenamed("id", "doc_id")).collect()
    sizes = Counter(r["part"] for r in rows)
    held = math.ceil(n * 0.2)
    assert len(rows) == len({r["doc_id"] for r in rows}) == n
    assert sizes["test"] == math.ceil(held * 0.5)
    assert sizes["val"] == held - sizes["test"]


def test_split_rows_is_exact_and_stable(spark):
    df = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("sentence_id"), (F.col("id") % 7 == 0).cast("int").alias("label")
    )
    first = {(r["doc_id"], r["part"]) for r in splits.split_rows(df).collect()}
    again = {(r["doc_id"], r["part"]) for r in splits.split_rows(df.repartition(3)).collect()}
    assert first == again
    assert Counter((d % 7 == 0) for d, p in first if p == "test") == {True: round(143 * 0.2), False: round(857 * 0.2)}


def test_bayes_equals_brute_force(spark):
    rows = [(1, 0, "aa bb", 1), (1, 1, "bb cc", 0), (2, 0, "cc cc dd", 0), (2, 1, "aa", 1), (3, 0, "!!", 0)]
    df = spark.createDataFrame(rows, "doc_id long, sentence_id int, sentence string, label int")
    model = naive_bayes.fit(df, [])
    got = {(r["doc_id"], r["sentence_id"]): r["score"] for r in naive_bayes.score(model, df).collect()}
    texts = [[t for t in s.split() if t != "!!"] for _, _, s, _ in rows]
    vocabulary = sorted({t for ts in texts for t in ts})
    idf = {t: math.log(6 / (1 + sum(t in ts for ts in texts))) + 1 for t in vocabulary}
    vectors = []
    for ts in texts:
        raw = {t: ts.count(t) * idf[t] for t in set(ts)}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1
        vectors.append({t: v / norm for t, v in raw.items()})
    logs = {}
    for c in (0, 1):
        mine = [v for v, r in zip(vectors, rows) if r[3] == c]
        sums = {t: sum(v.get(t, 0) for v in mine) + 1 for t in vocabulary}
        logs[c] = (math.log(len(mine) / 5), {t: math.log(sums[t] / sum(sums.values())) for t in vocabulary})
    for (d, s, _, _), v in zip(rows, vectors):
        jll = [logs[c][0] + sum(w * logs[c][1][t] for t, w in v.items()) for c in (0, 1)]
        assert got[(d, s)] == pytest.approx(1 / (1 + math.exp(jll[0] - jll[1])))


def test_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, prediction int")
    got = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    assert tuple(got["1"])[1:5] == pytest.approx((1.0, 0.5, 2 / 3, 2))
    assert tuple(got["0"])[1:5] == pytest.approx((2 / 3, 1.0, 0.8, 2))
    assert got["accuracy"]["f1"] == 0.75
    assert got["macro avg"]["f1"] == pytest.approx(0.733333, abs=1e-6)
    none = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    assert tuple({r["class"]: r for r in evaluation.classification_report(none).collect()}["1"])[1:4] == (0, 0, 0)


def test_summaries(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "doc_id long, sentences array<string>")
    scores = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), (1, 2, 0.5)], "doc_id long, sentence_id int, score double")
    assert {r["doc_id"]: r["text"] for r in summaries.from_scores(docs, scores, 2).collect()} == {1: "b c", 2: ""}


def test_mean_scores_of_nothing(spark):
    candidates = spark.createDataFrame([("s", 1, "")], "system string, doc_id long, text string")
    golds = spark.createDataFrame([(1, "x y")], "doc_id long, summary string")
    skipped = rouge.score_systems(candidates, golds, ("rouge1",), stem=False, skip_empty=True)
    assert rouge.mean_scores(skipped, "rouge1").count() == 0
    kept = rouge.mean_scores(rouge.score_systems(candidates, golds, ("rouge1",), stem=False), "rouge1").first()
    assert (kept["n_docs"], kept["rouge1_f"]) == (1, 0.0)


def test_sequences(spark):
    pairs = spark.createDataFrame([(1, "b a b a b", "a zz"), (2, "", "b")], "doc_id long, document string, summary string")
    vocabulary = sequences.fit_vocabulary(pairs, 2)
    got = {r["doc_id"]: r for r in sequences.prepare(pairs, vocabulary, 4, 3).collect()}
    assert got[1]["input_ids"] == [2, 3, 2, 3] and got[1]["labels"] == [3, 1, 0]
    assert got[2]["input_ids"] == [0, 0, 0, 0] and got[2]["labels"] == [2, 0, 0]


def test_chat(spark):
    docs = spark.createDataFrame([(1, 'say "hi"\n')], "doc_id long, document string")
    body = chat.requests(docs, "m").first()["body"]
    import json

    parsed = json.loads(body)
    assert parsed["messages"][1] == {"role": "user", "content": 'say "hi"\n'}
    assert (parsed["model"], parsed["temperature"], parsed["max_tokens"]) == ("m", 0.2, 256)
    replies = spark.createDataFrame([(1, '{"choices":[{"message":{"content":" ok "}}]}'), (2, "{broken"), (3, None)], "doc_id long, body string")
    assert {r["doc_id"]: r["text"] for r in chat.reply_texts(replies).collect()} == {1: "ok", 2: "", 3: ""}


def test_a_summary_is_not_repeated_per_sentence(spark):
    """A sentence carries the summary's counts of its own terms only."""
    rows = [(1, ["alpha beta", "gamma", "beta delta delta"], "beta beta delta omega sigma"), (2, ["alpha"], None)]
    golds = spark.createDataFrame(rows, "doc_id long, sentences array<string>, summary string")
    found = {(r["doc_id"], r["sentence_id"]): r["_summary_tf"] for r in labels._units(golds, [], 1).collect()}
    assert found == {
        (1, 0): {"beta": 2}, (1, 1): {}, (1, 2): {"beta": 2, "delta": 1}, (1, -1): {}, (2, 0): {}, (2, -1): {},
    }
