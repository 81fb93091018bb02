"""Merkle manifest against a plain recursive version."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from precis.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(digests):
    """The root and, for each leaf, its siblings from below."""
    proofs, paths, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, at in enumerate(paths):
            if (at ^ 1) < len(level):
                proofs[i].append(level[at ^ 1])
        paths = [at // 2 for at in paths]
        level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], proofs


def brute(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf(row)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {name: brute_tree([x[2] for x in sorted(trees[name])]) for name in names}
    root, above = brute_tree([made[name][0] for name in names])
    found = Counter()
    for name, upper in zip(names, above):
        subroot, proofs = made[name]
        for (known, doc_id, digest), proof in zip(sorted(trees[name]), proofs):
            found[doc_id if known else None, digest, subroot, root, h(*proof, *upper)] += 1
    return found


def run(spark, rows, height, extra=None):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in extra or ():
        docs = docs.withColumn(name, F.lit("x"))
    made = merkle.manifest(docs, carried={"own": F.lit(7)}, height=height)
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof", "own"]
    got = made.withColumn("digest", merkle.proof_digest(F.col("proof"))).withColumn(
        "folded", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r["folded"] == r["root"] and r["own"] == 7 for r in got)
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["digest"]) for r in got)


ODD = [
    (None, "no id", "en", "a", 5), (None, None, None, None, None), (1, "", "en", "", 0), (1, None, "en", None, None),
    (2, "same", "en", "a", 4), (2, "same", "en", "a", 4), (2, "same", "en", "a", 4), (-5, "é" * 10, "é", "b", 10),
    (9, "x" * 3_000_000, "", "c", 3_000_000), (-2**63, "least", "zz", "d", 5), (2**63 - 1, "most", "zz", "d", 4), (3, "=", "=", "-", 1),
]


@pytest.mark.parametrize("height", [2, 12])
def test_manifest_equals_brute_force(spark, height):
    rows = [(i * 3 % 101, f"text {i}", "en" if i < 67 else "fr", "s", i) for i in range(70)] + ODD
    assert run(spark, rows, height) == brute(rows)


def test_tables_of_few_rows_and_clashing_names(spark):
    names = ("tree", "digest", "kept", "idx", "n", "order", "block", "leaf", "root", "proof", "c0", "_at")
    for rows in (ODD[:1], ODD[2:4], [(1, "a", "x", "s", 1), (2, "b", "y", "s", 1)]):
        assert run(spark, rows, 2, names) == brute(rows)
    assert run(spark, [], 2) == Counter()
    with pytest.raises(ValueError, match="names"):
        merkle.manifest(spark.createDataFrame([], SCHEMA), carried={"leaf": F.lit(1)})


def test_a_change_is_found(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(9)], SCHEMA)
    other = merkle.record_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    made = merkle.manifest(docs, carried={"other": other}, height=2)
    got = made.select(merkle.folded(F.col("other"), F.col("proof")).alias("f"), "root").collect()
    assert len(got) == 9 and all(r["f"] != r["root"] for r in got)


def test_a_sweep_keeps_levels_and_sides():
    nodes = merkle.sweep_up(list("abcde"), 3)
    assert [len(x) for x in nodes] == [5, 3, 2, 1]
    assert nodes[1] == [h("a", "b"), h("c", "d"), h("e")] and nodes[2][1] == h(h("e"))
    proofs = merkle.sweep_down(nodes, ["Labove"])
    assert proofs[4] == [merkle.LONE, merkle.LONE, "L" + nodes[2][0], "Labove"]
    assert proofs[1] == ["La", "R" + nodes[1][1], "R" + nodes[2][1], "Labove"]
