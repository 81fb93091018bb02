"""Exact seeded splits without a global sort.

A row's place is its rank by a seeded hash. The hash value at each cut is found from a histogram of
hash prefixes (bounded size) and a ranking inside the one histogram cell that holds the cut; every
row is then assigned on its own by comparing its hash with the cuts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis import fixed_values as fixed
from precis.operators.transcripts import seeded_hash

_CELL_DIGITS = 4  # hex digits: 65,536 cells, so a cell holds n / 65,536 rows


def _cut_hashes(hashed: DataFrame, sizes: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Largest hash of each leading part, one row per group: ``(_group, cut_<part> ..)``.

    ``sizes`` maps a part to its cumulative number of rows, as a function of the group size.
    """
    cells = hashed.groupBy("_group", "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    in_order = Window.partitionBy("_group").orderBy("_cell")
    whole = Window.partitionBy("_group")
    cells = cells.select(
        "_group", "_cell", "_rows",
        (F.sum("_rows").over(in_order) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(whole).alias("_n"),
    )
    cuts = F.array(*[
        F.struct(F.lit(part).alias("part"), size(F.col("_n")).cast("long").alias("rank"))
        for part, size in sizes.items()
    ])
    wanted = (
        cells.select("*", F.explode(cuts).alias("_cut"))
        .where(F.col("_cut.rank") > F.col("_before"))
        .where(F.col("_cut.rank") <= F.col("_before") + F.col("_rows"))
        .select("_group", "_cell", "_cut.part", (F.col("_cut.rank") - F.col("_before")).alias("_at"))
    )
    # One row per group and part; the number of groups is the number of classes.
    inside = hashed.join(F.broadcast(wanted.select("_group", "_cell").distinct()), ["_group", "_cell"])
    place = F.row_number().over(Window.partitionBy("_group", "_cell").orderBy("_hash"))
    found = inside.withColumn("_at", place).join(wanted, ["_group", "_cell", "_at"])
    picks = [
        F.max(F.when(F.col("part") == part, F.col("_hash"))).alias(f"cut_{part}") for part in sizes
    ]
    return found.groupBy("_group").agg(*picks)


def _assign(
    df: DataFrame, keys: list[str], group: Column, seed: int,
    sizes: dict[str, Callable[[Column], Column]], rest: str,
) -> DataFrame:
    hashed = df.withColumn("_group", group).withColumn("_hash", seeded_hash(seed, *keys))
    cells = hashed.select("_group", "_hash", F.substring("_hash", 1, _CELL_DIGITS).alias("_cell"))
    cuts = _cut_hashes(cells, sizes)
    part = F.lit(rest)
    for name in reversed(list(sizes)):
        part = F.when(F.col("_hash") <= F.col(f"cut_{name}"), F.lit(name)).otherwise(part)
    return hashed.join(F.broadcast(cuts), "_group", "left").select(*df.columns, part.alias("part"))


def split_rows(
    labeled: DataFrame, test_fraction: float = fixed.TEST_FRACTION, seed: int = fixed.SEED
) -> DataFrame:
    """Add ``part``: exactly ``round(fraction * n)`` rows of each label are ``test``, the rest ``train``."""
    return _assign(
        labeled, ["doc_id", "sentence_id"], F.col("label"), seed,
        {"test": lambda n: F.round(n * test_fraction)}, "train",
    )


def split_documents(
    documents: DataFrame, rest_fraction: float = fixed.TEST_FRACTION, seed: int = fixed.SEED
) -> DataFrame:
    """``(doc_id, part)``: ``ceil(fraction * n)`` documents are held out, half ``test``, half ``val``.

    ``documents`` must hold each ``doc_id`` once. Sentences of one document share its part.
    """
    held_out = lambda n: F.ceil(n * rest_fraction)
    sizes = {"test": lambda n: F.ceil(held_out(n) * 0.5), "val": held_out}
    return _assign(documents.select("doc_id"), ["doc_id"], F.lit(0), seed, sizes, "train")


def members(df: DataFrame, split: DataFrame, *parts: str) -> DataFrame:
    """Rows whose document belongs to one of the parts."""
    return df.join(split.where(F.col("part").isin(*parts)), "doc_id", "left_semi")


def others(df: DataFrame, split: DataFrame, *parts: str) -> DataFrame:
    """Rows whose document belongs to none of the parts."""
    return df.join(split.where(F.col("part").isin(*parts)), "doc_id", "left_anti")
