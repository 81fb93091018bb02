"""One-permutation MinHash: edits, equality, likeness against true similarity, odd rows."""

import hashlib
import random

from pyspark.sql import functions as F

from precis.llm import fingerprints


def grams(text, n=5):
    words = [w for w in text.lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def jaccard(a, b):
    one, two = grams(a), grams(b)
    return len(one & two) / len(one | two)


def rows():
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(500)}é" for _ in range(n))
    made = [(i, text(rng.choice([1, 3, 8, 40, 200, 900]))) for i in range(60)]
    base = text(300)
    made += [(100 + i, base if i % 2 else " ".join(base.split(" ")[i:])) for i in range(6)]
    return made + [(200, None), (201, ""), (None, "null id"), (300, "A b"), (300, "A b"), (300, "C d e")]


def test_edits_and_likeness(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = fingerprints.fingerprints_with_edits(docs.repartition(4)).collect()
    assert len(got) == len(rows())
    plain = [(d, t or "") for d, t in rows() if d != 300]
    plain.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    following = {d: plain[(i + 1) % len(plain)][1] for i, (d, _) in enumerate(plain)}
    texts, errors = dict(plain), []
    by_id = {r["doc_id"]: r for r in got}
    for d, text in plain:
        if d is None:  # its next one is the first, of which there are three texts
            continue
        third = len(text) // 3
        edited = text[:len(text) - third] + following[d][:third]
        r = by_id[d]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == 2 * fingerprints.BINS
        errors.append(abs(r["near_edited"] - jaccard(text, edited)))
        errors.append(abs(r["near_next"] - jaccard(text, following[d])))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.03
    for d in (101, 103, 105):
        assert by_id[d]["fingerprint"] == by_id[101]["fingerprint"] and texts[d] == texts[101]
    assert by_id[200]["fingerprint"] == by_id[201]["fingerprint"]


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    (r,) = fingerprints.fingerprints_with_edits(docs).collect()
    assert r["near_next"] == 1.0
    assert fingerprints.fingerprints_with_edits(docs.limit(0)).count() == 0


def test_optimal_densification_is_consistent(spark):
    """Few shingles: the likeness of sets that share half their shingles stays unbiased."""
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        words = [f"x{rng.randrange(10**6)}" for _ in range(24)]
        pairs.append((" ".join(words[:16]), " ".join(words[:8] + words[16:])))
    df = spark.createDataFrame(pairs, "a string, b string").select(
        fingerprints.fingerprint(F.col("a"), 1).alias("a"), fingerprints.fingerprint(F.col("b"), 1).alias("b"))
    mean = df.select(F.avg(fingerprints.likeness(F.col("a"), F.col("b")))).first()[0]
    assert abs(mean - 1 / 3) < 0.03


def test_native(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    plan = fingerprints.fingerprints_with_edits(docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoop"))
