"""Exact Jaccard join and components against brute force."""

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from precis.llm import components, jaccard


def brute(rows, n=5, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        grams = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
        sets.append(grams or ({tuple(words)} if words else set()))
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            common = len(one & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and common:
                if 100 * common >= percent * len(one | sets[j]):
                    a, b = top(rows[i][0]), top(rows[j][0])
                    parent[max(a, b)] = min(a, b)
    return sorted([(d, len(s), top(d) if d is not None else None) for (d, _), s in zip(rows, sets)], key=str)


def fixture():
    rng = random.Random(3)
    rows = [(None, "a b c d e f"), (900, None), (901, " \t"), (902, "A b"), (903, "a  B"), (904, "a"), (905, "a b c d e f")]
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([30, 60, 100]))] for _ in range(12)]
    for i in range(250):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = words[:rng.randint(4, len(words))] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 10))]
        text = " ".join(words)
        rows.append((i, text.upper() if rng.random() < 0.2 else text))
    return rows + rows[20:25]


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({name: F.lit(1) for name in ("doc", "rep", "n", "grams", "leader")})
    return sorted(map(tuple, jaccard.similar_sets(docs).select("doc", "n", "component").collect()), key=str)


def test_equals_brute_force(spark):
    assert found(spark, fixture()) == brute(fixture())


def test_equals_brute_force_with_many_blocks(spark, monkeypatch):
    """Blocks of three entries, so that every longer list is dealt out by pairs of blocks."""
    monkeypatch.setattr(jaccard, "_BLOCK", 3)
    monkeypatch.setattr(jaccard, "_MEMBERS", 3)
    monkeypatch.setattr(jaccard, "_COLUMNS", 5)
    cloudpickle.register_pickle_by_value(jaccard)
    try:
        assert found(spark, fixture()) == brute(fixture())
    finally:
        cloudpickle.unregister_pickle_by_value(jaccard)


def brute_links(rows, n=5, percent=80):
    sets = {}
    for doc, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        grams = frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])
        if doc is not None and grams:
            sets[grams] = min(sets.get(grams, doc), doc)
    return {(min(sets[x], sets[y]), max(sets[x], sets[y])) for x in sets for y in sets
            if sets[x] < sets[y] and 100 * len(x & y) >= percent * len(x | y)}


def test_every_link_inside_components(spark):
    """A family of different near copies, each similar to all others."""
    base = [f"w{i}" for i in range(200)]
    rows = fixture() + [(1000 + i, " ".join(base[:2 * i] + ["x"] + base[2 * i + 1:])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    links, members = jaccard.linked_sets(docs)
    expected = brute_links(rows)
    assert sum(a >= 1000 for a, _ in expected) == 780
    assert sorted(map(tuple, links.select("a", "b").collect())) == sorted(expected)
    ends = Counter(x for pair in expected for x in pair)
    members = members.collect()
    assert sorted(((r["doc"], r["n"], r["component"]) for r in members), key=str) == brute(rows)
    assert all(r["n_links"] == ends[r["rep"]] for r in members)


def test_a_family_lists_few_pairs(spark):
    """Near copies that are mostly not linked: their answers come from their groups, not from listed pairs."""
    rng, base = random.Random(6), [f"w{i}" for i in range(200)]
    rows = []
    for i in range(200):
        words = list(base)
        for place in rng.sample(range(20), 6):
            words[10 * place] = f"x{place}"
        rows.append((i, " ".join(words)))
    join = jaccard._Join(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Settings(), "doc_id", "text")
    links = brute_links(rows)
    assert join.across.count() + join.within(listed=True).count() == len(links) > 30
    assert join.members.count() >= 180 and join.listed.count() < 10 * len(links)
    assert sorted(map(tuple, join.found().select("doc", "n", "component").collect()), key=str) == brute(rows)


def test_answers_of_a_block_pair():
    """Sets of a group, known by their differences to the leader, against the sets themselves."""
    rng = random.Random(9)
    leader = set(range(60))
    sets = [leader ^ set(rng.sample(range(90), rng.randrange(25))) for _ in range(40)]
    table = pa.table({"doc": list(range(40)), "n": [len(x) for x in sets], "block": [i % 2 for i in range(40)],
                      "grams": pa.array([sorted(x ^ leader) for x in sets], pa.list_(pa.int64()))})
    linked = {(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    for one, two in ((0, 1), (0, 0)):
        part = table if one != two else table.filter(pa.compute.equal(table["block"], 0))
        mine = {(i, j) for i, j in linked if {i % 2, j % 2} == {one, two}}
        key = (pa.scalar(0), pa.scalar(one), pa.scalar(two))
        pairs = jaccard._group_links(80, True)(key, part)
        assert set(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())) == mine and pairs.num_rows == len(mine) > 0
        answers = jaccard._group_links(80, False)(key, part)
        assert dict(zip(answers["doc"].to_pylist(), answers["n_links"].to_pylist())) == Counter(x for p in mine for x in p)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(1, 41)} == {1}
    assert {got[i] for i in range(100, 160)} == {100}
    assert got[300] == got[299] == 299
    assert Counter(got.values())[100] == 60
