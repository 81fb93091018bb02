"""Suffix-sort removal of repeats against brute force."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from precis.llm import repeats


def brute(rows, depth=50):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - depth + 1):
            if doc is not None:
                first[data[i:i + depth]] = min(first.get(data[i:i + depth], doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [0] * len(data)
        for i in range(len(data) - depth + 1):
            if doc is not None and first[data[i:i + depth]] < doc:
                gone[i:i + depth] = [1] * depth
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(5)
    words = ["ab", "thé", "on", "日本", "x", "lorem", "ipsum"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(60) for _ in range(6)]
    rows = [(None, base[0]), (100, None), (101, ""), (7, base[0]), (7, base[0]), (7, base[1])]
    for i in range(150):
        made = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            source = rng.choice(base)
            at = rng.randint(0, len(source) - 1)
            made += source[at:at + rng.randint(10, 200)] + text(rng.randint(0, 10))
        rows.append((i, made))
    return rows + [(500, "a" * 3000), (501, "b" + "a" * 2000), (3, "a" * 60)]


OUTPUTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, repeats.remove_repeats(docs, ("doc_id",), OUTPUTS, **options).collect()), key=str)


def test_equals_brute_force(spark):
    assert found(spark, fixture()) == brute(fixture())


def test_equals_brute_force_in_many_small_parts(spark, monkeypatch):
    """Limits so small that batches, chunks and buckets are cut everywhere and large buckets dealt again."""
    for name, value in {"_ROWS": 20, "_BUCKET": 10, "_SEEN": 7, "_CHUNK": 512}.items():
        monkeypatch.setattr(repeats, name, value)
    monkeypatch.setattr(repeats, "_LOW", repeats.np.uint64(1023))
    cloudpickle.register_pickle_by_value(repeats)
    try:
        assert found(spark, fixture()) == brute(fixture())
    finally:
        cloudpickle.unregister_pickle_by_value(repeats)


def test_other_depth_and_empty_table(spark):
    rows = [(i, "0123456789abcdefghijklmnop" * 2 + str(i)) for i in range(4)]
    assert found(spark, rows, depth=30) == brute(rows, 30)
    assert found(spark, []) == []
    with pytest.raises(ValueError):
        found(spark, rows, depth=10)


def test_clashing_columns_and_text(spark):
    docs = spark.createDataFrame(
        [(1, "é" * 60, "a"), (2, "x" + "é" * 60 + "y", "b")], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs, ("doc_id", "kept", "text"), ("kept", "kept_text")).collect()}
    assert bytes(got[2]["kept"]) == b"xy" and got[2]["kept_text"] == "xy" and got[1]["kept_text"] == "é" * 60


def test_one_window_slices_of_a_large_bucket(monkeypatch):
    """The same slice of one window before and after the bucket is dealt again, and inside longer ones."""
    for name, value in {"_ROWS": 20, "_BUCKET": 10}.items():
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(8)
    made = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    early, late, inside = made(50), made(50), made(50)
    slices = [made(60) for _ in range(300)]
    slices[3], slices[150], slices[200] = early, made(4) + early + made(4), early
    slices[160], slices[250] = late, late
    slices[5], slices[220] = made(9) + inside, inside
    rows = [(1, piece, doc, doc, 0, len(piece)) for doc, piece in enumerate(slices)]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(rows, **options):
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list("abcdef"))
        return [r for b in repeats._sort_buckets(50, **options)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]

    first = run(rows)
    again = sorted((r for r in first if r[1] is not None), key=lambda r: (r[0], r[2]))
    assert again
    spans = [r for r in first if r[1] is None] + run(again, again=True)
    assert sorted(r[2:] for r in spans if r[1] is None and r[3] is not None) == [
        (150, 150, 4, 54), (200, 200, 0, 50), (220, 220, 0, 50), (250, 250, 0, 50)]
