"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a hash of the row. What a source gives is decided for whole blocks: as
many full passes over all of them as the target holds, then blocks in a random order that fit into the
rest; the first one that does not is taken row by row. The numbers of block draws of all sources, the quotas, are
then split exactly among the output shards by a tree: every node hands a multivariate-hypergeometric
sample of its draws to its left half and the rest to its right half. Each shard draws the next blocks of
every source's permuted order, so no block draw is used twice, and shuffles its rows locally.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from precis.llm.common import written

_BLOCKS = 1024
_SOURCES = 100_000
_BROADCAST = 200_000  # rows of blocks


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(spaced == "", F.lit(0)).otherwise(
        F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the whole size by weight, stopped at ``most`` times a source's own size.

    The excess is shared by weight among the others until none is above.
    """
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    result = [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        above = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not above:
            for i in open_:
                result[i] = level * weights[i]
            break
        for i in above:
            result[i] = most * sizes[i]
            left -= result[i]
        open_ -= above
    return result


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Exact quotas of every shard (rows) and source (columns); shards get equally many draws, give or take one."""
    if shards == 1:
        return quotas[None, :]
    half = shards // 2
    share = int(quotas.sum()) * half // shards
    left = rng.multivariate_hypergeometric(quotas, share, method="marginals") if len(quotas) else quotas
    return np.concatenate([split_quotas(left, half, rng), split_quotas(quotas - left, shards - half, rng)])


def plan_draws(blocks: pd.DataFrame) -> pd.DataFrame:
    """Draws of each block of one source: the full passes, and one more for blocks in random order that
    fit into the rest of the target. The first one that does not fit is drawn up to ``room`` words."""
    blocks = blocks.sort_values(["order", "block"]).reset_index(drop=True)
    blocks["nth"], blocks["draws"], blocks["room"] = range(len(blocks)), blocks["passes"], np.nan
    room, words = float(blocks["rest"].iloc[0]), blocks["words"].to_numpy()
    extra = np.zeros(len(blocks), dtype=int)
    for i, size in enumerate(words.tolist()):
        if 0 < size <= room:
            extra[i], room = 1, room - size
    open_ = np.flatnonzero((extra == 0) & (words > room))
    if room > 0 and len(open_):
        extra[open_[0]] = 1
        blocks.loc[open_[0], "room"] = room
    blocks["draws"] += extra
    blocks["extra_nth"] = np.where(extra, extra.cumsum() - 1, -1)
    return blocks[["number", "block", "nth", "extra_nth", "words", "passes", "draws", "room"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, shards: int = 8, seed: int = 0,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All columns of ``docs`` plus ``size, source_size, target, copies, shards`` of every row.

    ``copies`` is how often the mix takes the row (0 to ``most``), ``shards`` the array of the output
    shards that take it, one entry for each copy; ``shard_order`` orders the rows within a shard. Sources
    in the order of code points, null last, have the ``weights`` in turn. The words that the mix takes of
    a source come within one row of its target, whole texts only. A run depends on seed and rows alone.

    A null or empty text has size 0 and is not taken. A null source is a source of its own. Rows that are
    equal in id and text share their draws, but for those at the cut of a source, of which as many as fit are taken. A column of ``docs`` with the name of a result gives way to
    it. The driver handles one row for each source and block (at most ``_SOURCES`` sources, else an error).
    """
    new = ("size", "source_size", "target", "copies", "shards", "shard_order")
    kept = [c for c in docs.columns if c not in new]
    row_hash = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    slim = docs.select(F.col(source).alias("source"), row_hash.alias("h"), word_count(F.col(text)).alias("size"))
    slim = written(slim.withColumn("block", F.pmod("h", F.lit(_BLOCKS)).cast("int")), "mix-rows")
    blocks = slim.groupBy("source", "block").agg(F.sum("size").alias("words"))
    named = blocks.groupBy("source").agg(F.sum("words").alias("words")).limit(_SOURCES + 1).collect()
    if len(named) > _SOURCES:
        raise ValueError(f"more than {_SOURCES} sources")
    named.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in named]
    goals = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], float(most))
    plan = pd.DataFrame({
        "number": range(len(named)), "source": pd.Series([r["source"] for r in named], dtype=object),
        "source_size": sizes, "target": goals,
        "passes": [int(g // s) if s else 0 for g, s in zip(goals, sizes, strict=True)],
    })
    plan["rest"] = [g - p * s for g, p, s in zip(plan["target"], plan["passes"], plan["source_size"], strict=True)]
    spark = docs.sparkSession
    plan_rows = spark.createDataFrame(
        [tuple(r) for r in plan.itertuples(index=False)] if len(plan) else [],
        "number int, source string, source_size long, target double, passes int, rest double")

    # A group is one source's blocks, at most _BLOCKS rows.
    dealt = blocks.withColumnRenamed("source", "s").join(F.broadcast(plan_rows), F.col("s").eqNullSafe(F.col("source")))
    dealt = dealt.withColumn("order", F.xxhash64(F.lit(seed + 1), "number", "block"))
    dealt = dealt.select("number", "block", "order", "words", "passes", "rest").groupBy("number").applyInPandas(
        plan_draws, "number int, block int, nth int, extra_nth int, words long, passes int, draws int, room double")
    dealt = written(dealt, "mix-blocks")
    drawn = dealt.groupBy("number").agg(F.sum("draws").alias("q"), F.count("*").alias("blocks")).toPandas()
    quotas = np.zeros(len(named), dtype=np.int64)
    quotas[drawn["number"].to_numpy(np.int64)] = drawn["q"].to_numpy(np.int64)
    split = split_quotas(quotas, shards, np.random.default_rng(seed))
    ends = np.cumsum(split, axis=0)  # draw positions at which each shard of a source ends
    end_rows = spark.createDataFrame(
        [(i, [int(x) for x in ends[:, i]]) for i in range(len(named))], "number int, ends array<long>")
    counts = spark.createDataFrame(
        [(int(n), int(b)) for n, b in zip(drawn["number"], drawn["blocks"], strict=True)], "number int, blocks long")

    # The draws of a source in order: pass by pass, each in the permuted order of the blocks.
    passes = F.filter(F.sequence(F.lit(0), F.col("passes")), lambda p: p < F.col("passes"))
    positions = F.concat(
        F.transform(passes, lambda p: p * F.col("blocks") + F.col("nth")),
        F.when(F.col("extra_nth") >= 0, F.array(F.col("passes") * F.col("blocks") + F.col("extra_nth"))).otherwise(
            F.array().cast("array<bigint>")))
    shard_of = F.transform(positions, lambda x: F.size(F.filter(F.col("ends"), lambda e: e <= x)))
    dealt = dealt.join(F.broadcast(end_rows), "number").join(F.broadcast(counts), "number")
    dealt = dealt.select("number", "block", "passes", "room", shard_of.alias("draw_shards"))
    dealt = dealt.join(F.broadcast(plan_rows.select("number", "source", "source_size", "target")), "number").select(
        F.col("source").alias("_source"), F.col("block").alias("_block"), "source_size", "target", "passes", "room", "draw_shards")

    # Only one block of a source is taken row by row, in random order.
    key = F.xxhash64(F.lit(seed + 2), "h")
    last = dealt.filter(F.col("room").isNotNull()).select("_source", "_block", "room")
    cuts = written(cut_points(slim.withColumn("key", key), last), "mix-cuts")
    dealt = dealt.join(F.broadcast(cuts), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left")
    dealt = dealt.select("_source", "_block", "source_size", "target", "passes", "draw_shards",
                         F.col("room").isNotNull().alias("cut_short"), F.coalesce("cut", F.lit(-(1 << 63))).alias("cut"))

    rows = docs.select(*kept, row_hash.alias("h"), word_count(F.col(text)).alias("size"))
    tied = cuts.filter(F.col("takes") < F.col("n")).select(F.col("_s").alias("_source"), "cut", "takes").collect()  # one a source at most
    side = F.broadcast(dealt) if len(named) * _BLOCKS <= _BROADCAST else dealt
    rows = rows.join(side, F.col(source).eqNullSafe(F.col("_source")) & (F.pmod("h", F.lit(_BLOCKS)) == F.col("_block")), "left")
    left_out = F.col("cut_short") & (key > F.col("cut"))
    if tied:
        rows = _numbered_ties(rows.withColumn("_key", key), tied, source)
        left_out = left_out | (F.col("cut_short") & F.coalesce(F.col("_surplus"), F.lit(False)))
    taken = F.when(F.col("size") == 0, F.array().cast("array<int>")).when(
        left_out, F.slice("draw_shards", F.lit(1), F.col("passes"))).otherwise(F.col("draw_shards"))
    return rows.select(
        *kept, "size", "source_size", "target", F.size(taken).alias("copies"), taken.alias("shards"),
        F.xxhash64(F.lit(seed + 3), "h").alias("shard_order"))


def cut_points(rows: DataFrame, last: DataFrame) -> DataFrame:
    """``_s, _b, cut, takes, n``: where each block of ``last`` (``_source, _block, room``) is cut.

    ``rows`` (``source, block, key, size``) are taken in the order of ``key`` while half of a row fits
    into the room; ``cut`` is the last key taken, ``takes`` how many of its ``n`` equal rows. Equal rows
    are counted before they are ordered, and a block is ordered in 65,536 pieces by the first bits of the key.
    """
    same_block = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    inside = rows.filter(F.col("size") > 0).join(F.broadcast(last), same_block)
    inside = inside.withColumn("piece", F.shiftright("key", 48))
    keys = inside.groupBy("source", "block", "piece", "key").agg(
        F.count("*").alias("n"), F.first("size").alias("size"), F.first("room").alias("room"))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    words = F.sum(F.col("n") * F.col("size"))
    pieces = keys.groupBy("source", "block", "piece").agg(words.alias("words"))
    before = F.sum("words").over(until(Window.partitionBy("source", "block").orderBy("piece")))
    pieces = pieces.select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("piece").alias("_p"), F.coalesce(before, F.lit(0)).alias("before"))
    in_piece = words.over(until(Window.partitionBy("source", "block", "piece").orderBy("key")))
    same_piece = F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")) & (F.col("piece") == F.col("_p"))
    started = keys.withColumn("start", F.coalesce(in_piece, F.lit(0))).join(pieces, same_piece)
    fits = F.floor((F.col("room") - F.col("start") - F.col("before")) / F.col("size") + 0.5)
    started = started.withColumn("takes", F.least(F.col("n"), F.greatest(fits, F.lit(0))))
    best = F.max_by(F.struct("key", "takes", "n"), "key").alias("best")
    cuts = started.filter(F.col("takes") > 0).groupBy("_s", "_b").agg(best)
    return cuts.select("_s", "_b", F.col("best.key").alias("cut"), "best.takes", "best.n")


def _numbered_ties(rows: DataFrame, tied: list[Row], source: str) -> DataFrame:
    """``rows`` with ``_surplus``: true for those equal rows at a cut that are beyond its ``takes``.

    The tied rows are written once and numbered by task: a number within the task, and the sum of the
    tasks before it. No text is ordered.
    """
    spark = rows.sparkSession
    ties = F.broadcast(spark.createDataFrame(
        [(r["_source"], r["cut"], r["takes"]) for r in tied], "_tied_source string, _cut long, _takes long"))
    found = rows.join(ties, F.col(source).eqNullSafe(F.col("_tied_source")) & (F.col("_key") == F.col("_cut")), "left")
    found = written(found.withColumn("_at", F.monotonically_increasing_id()), "mix-tied")
    slim = found.filter(F.col("_cut").isNotNull()).select(
        "_at", "_cut", "_tied_source", "_takes", F.shiftright("_at", 33).alias("_task"))
    nth = F.row_number().over(Window.partitionBy("_tied_source", "_cut", "_task").orderBy("_at"))
    counts = slim.groupBy("_tied_source", "_cut", "_task").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_tied_source", "_cut").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("_tied_source").alias("_ts"), F.col("_cut").alias("_tc"), F.col("_task").alias("_tt"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_tied_source").eqNullSafe(F.col("_ts")) & (F.col("_cut") == F.col("_tc")) & (F.col("_task") == F.col("_tt"))
    surplus = slim.withColumn("_nth", nth).join(counts, same).select(
        "_at", (F.col("_before") + F.col("_nth") > F.col("_takes")).alias("_surplus"))
    return found.drop("_key", "_cut", "_tied_source", "_takes").join(surplus, "_at", "left").drop("_at")
