"""Merkle manifest of a table by time-forward processing.

The nodes of a tree are labelled by level and position, so every child comes before its parent. A node
sends its digest as a message to the label of its parent, and a queue ordered by label delivers the
messages; a second sweep goes through the labels backwards and hands every child the siblings above it.

The queue is external: a sweep is cut into slices of ``height`` levels, and the messages between two
slices are a written table that Spark shuffles and sorts by label. Within a slice the subtree of at most
``2 ** height`` nodes is one group with a heap of its own. No task holds more than such a subtree, whatever
the size of a tree, and a table of 10^11 rows needs four slices. Texts are read once, to be hashed;
after that only digests travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import written

HEIGHT = 12  # levels of a slice
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LONE = "-"  # in a proof: a level at which the node has no sibling
_PLACED_BITS = 33  # of monotonically_increasing_id, the bits below the partition


def record_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of values as text, each ``-`` if null and else its UTF-8 byte count, ``:`` and itself."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _levels(n: int, height: int) -> int:
    """Levels that a slice adds to a tree with ``n`` nodes at its lowest level."""
    return min(height, (n - 1).bit_length())


def sweep_up(digests: Sequence[str], levels: int) -> list[list[str]]:
    """The nodes of a subtree, level by level from its lowest nodes to its root."""
    width = max(len(digests), 1)
    nodes: list[list[str]] = [list(digests)] + [[] for _ in range(levels)]
    # A message: label of the receiver, position of the sender, digest.
    queue = [(width + at // 2, at, digest) for at, digest in enumerate(digests)] if levels else []
    while queue:
        label, received = queue[0][0], []
        while queue and queue[0][0] == label:
            received.append(heappop(queue)[2])
        level, at = divmod(label, width)
        nodes[level].append(_joined(received))
        if level < levels:
            heappush(queue, ((level + 1) * width + at // 2, at, nodes[level][-1]))
    return nodes


def sweep_down(nodes: list[list[str]], above: list[str]) -> list[list[str]]:
    """For each lowest node of a subtree its siblings, upwards, and then those of the subtree's root.

    A sibling is ``L`` or ``R``, the side where it stands, and its digest, or ``LONE``.
    """
    width, proofs = max(len(nodes[0]), 1), [[] for _ in nodes[0]]
    queue = [(-(len(nodes) - 1) * width, above)]  # the largest label first
    while queue:
        label, suffix = heappop(queue)
        level, at = divmod(-label, width)
        if not level:
            proofs[at] = suffix
            continue
        below = nodes[level - 1]
        for child in range(2 * at, min(2 * at + 2, len(below))):
            other = child ^ 1
            sibling = ("R" if child < other else "L") + below[other] if other < len(below) else LONE
            heappush(queue, (-((level - 1) * width + child), [sibling, *suffix]))
    return proofs


def _ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add ``idx``, the position of a row in its ``tree`` by ``order``, and ``n``, the size of the tree.

    Rows are dealt out by ranges, so one large tree takes many tasks; positions come from totals per
    task and tree and their prefix sums.
    """
    keys = [F.col("tree"), *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    task = F.shiftright("_at", _PLACED_BITS)
    starts = placed.groupBy("tree", task.alias("_task")).agg(F.min("_at").alias("_least"), F.count("*").alias("_count"))
    whole = Window.partitionBy("tree")
    before = F.sum("_count").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(
        "tree", "_task", (F.coalesce(before, F.lit(0)) - F.col("_least")).alias("_shift"), F.sum("_count").over(whole).alias("n"))
    found = placed.withColumn("_task", task).join(starts, ["tree", "_task"])
    return found.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def _block(height: int) -> Column:
    return F.shiftright("idx", height).alias("block")


def _up(rows: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The lowest nodes of every slice, and ``tree, digest`` of every root."""
    schema = "tree string, idx long, n long, digest string"

    def blocks(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = table.column("n")[0].as_py()
        top = sweep_up(table.column("digest").to_pylist(), _levels(n, height))[-1]
        return pa.table({"tree": [key[0].as_py()], "idx": pa.array([key[1].as_py()], pa.int64()),
                         "n": pa.array([-(-n >> height) if n > 1 << height else 1], pa.int64()), "digest": top})

    slices, roots, spark = [], None, rows.sparkSession
    while True:
        slices.append(rows)
        lowest = rows.select("tree", _block(height), "idx", "n", "digest")
        tops = written(lowest.groupBy("tree", "block").applyInArrow(blocks, schema), "merkle-slice")
        done = tops.filter("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.union(done)
        rows = tops.filter("n > 1")
        if rows.isEmpty():
            return slices, roots


def _down(slices: list[DataFrame], above: DataFrame, height: int, kind: str) -> DataFrame:
    """``kept``, ``subroot``, ``root`` and ``proof`` of every node of the first slice.

    ``above`` has the proof suffix of each root: ``tree, subroot, root, proof``. ``kind`` is the type of ``kept``.
    """
    arrived = written(above.withColumn("block", F.lit(0).cast("long")), "merkle-above")
    fields = f"tree string, block long, kept {kind}, subroot string, root string, proof array<string>"
    for number in reversed(range(len(slices))):
        def blocks(key: tuple, nodes: pa.Table, message: pa.Table) -> pa.Table:
            nodes = nodes.sort_by("idx")
            digests, levels = nodes.column("digest").to_pylist(), _levels(nodes.column("n")[0].as_py(), height)
            suffix = message.column("proof")[0].as_py()
            proofs = sweep_down(sweep_up(digests, levels), suffix)
            rows = nodes.num_rows
            same = lambda name: pa.array([message.column(name)[0].as_py()] * rows, pa.string())
            return pa.table({
                "tree": nodes.column("tree"), "block": nodes.column("idx"), "kept": nodes.column("kept"),
                "subroot": same("subroot"), "root": same("root"), "proof": pa.array(proofs, pa.list_(pa.string()))})

        rows = slices[number]
        if "kept" not in rows.columns:
            rows = rows.withColumn("kept", F.lit(None).cast(kind))
        nodes = rows.select("tree", _block(height), "idx", "n", "digest", "kept")
        # A tree that was complete in an earlier slice gets its message there.
        if number:
            waiting = slices[number].select("tree").distinct()
            early = arrived.join(waiting, "tree", "left_anti")
            arrived = arrived.join(waiting, "tree", "left_semi")
        found = nodes.groupBy("tree", "block").cogroup(arrived.groupBy("tree", "block")).applyInArrow(blocks, fields)
        if number:
            arrived = written(found.drop("kept").unionByName(early), "merkle-proofs")
    return found


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    tree: str = "lang",
    order: str = "doc_id",
    carried: Mapping[str, Column] | None = None,
    height: int = HEIGHT,
) -> DataFrame:
    """A row ``<order>, leaf, subroot, root, proof`` for each row, with the columns ``carried`` after them.

    A leaf is the digest of the ``fields``. The leaves of one value of ``tree`` ascend by ``order``; two
    neighbours at a time are joined to a digest of their hex texts, a last one alone, until one is left,
    the ``subroot``. Subroots ascend by value, null first and else by UTF-8 bytes, and are joined
    in the same way to the ``root``. A ``proof`` has an entry for each level from the leaf to the root.

    A null ``order`` comes first. Rows that share it ascend by their digests; rows that are equal in all
    fields take neighbouring places, and which has which makes no difference. No rows give no rows.
    Null and empty fields differ (``-`` and ``0:``). Texts of any length are hashed whole.
    Other columns of the table are not looked at; names of ``carried`` may not repeat the five of the result.
    """
    named = dict(carried or {})
    own = {order, "leaf", "subroot", "root", "proof"}
    if own & set(named):
        raise ValueError(f"names of the result: {sorted(own & set(named))}")
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))  # "-" sorts before "="
    digest = record_digest([F.col(f) for f in fields])
    others = [c.alias(f"c{i}") for i, c in enumerate(named.values())]
    leaves = docs.select(name.alias("tree"), digest.alias("digest"), F.col(order).alias("order"), *others)
    # Equal rows in the order in which they were written, so that a repeated row can be split over tasks.
    leaves = written(leaves.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    leaves = _ranked(leaves, [F.col("order"), F.col("digest"), F.col("_row")])
    kept = F.struct("order", "digest", *[f"c{i}" for i in range(len(named))]).alias("kept")
    leaves = written(leaves.select("tree", "idx", "n", "digest", kept), "merkle-ranked")

    slices, subroots = _up(leaves, height)
    names = subroots.select(F.lit("").alias("tree"), "digest", F.struct("tree").alias("kept"))
    names = written(_ranked(names, [F.col("kept.tree")]), "merkle-subroots")
    upper, roots = _up(names, height)
    none = F.array().cast("array<string>")
    top = roots.select("tree", F.lit("").alias("subroot"), F.col("digest").alias("root"), none.alias("proof"))
    found = _down(upper, top, height, "struct<tree:string>")
    above = found.select(F.col("kept.tree").alias("tree"), "root", "proof")
    above = above.join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    above = above.select("tree", "subroot", "root", "proof")
    proofs = _down(slices, above, height, leaves.schema["kept"].dataType.simpleString())
    return proofs.select(
        F.col("kept.order").alias(order), F.col("kept.digest").alias("leaf"), "subroot", "root", "proof",
        *[F.col(f"kept.c{i}").alias(n) for i, n in enumerate(named)])


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the siblings of a proof, upwards, as one text."""
    return F.sha2(F.array_join(F.transform(F.filter(proof, lambda x: x != LONE), lambda x: F.substring(x, 2, 64)), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    def step(digest: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, 64)
        joined = F.when(sibling == LONE, digest).when(sibling.startswith("L"), F.concat(other, digest))
        return F.sha2(joined.otherwise(F.concat(digest, other)), 256)

    return F.aggregate(proof, leaf, step)
