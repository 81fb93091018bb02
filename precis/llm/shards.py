"""Contiguous shards of nearly equal bytes from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import written


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_by_bytes(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: documents in the order of their ids, cut at equal targets.

    Ids, sizes and checksums (never texts) are sorted by range partitions. The totals of the partitions,
    one row each, are summed up to give every partition's offset; the position of a row is its offset
    plus the prefix sum within its partition. A row belongs to the shard that holds the middle of its
    bytes, so a shard misses its target by less than one document. ``slot`` counts the rows of a shard
    from 0 without gaps.

    Rows with equal ids follow in the order of size and checksum; null ids come first. A null text has
    size 1 and the checksum of nothing. Repeated rows each get a place of their own; equal texts may lie
    in different shards, whatever share of the rows they are. An empty table gives an empty table.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), byte_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ("doc_id", "size", "text_crc32")
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranges = written(dealt, "ranges")
    # One row for each range partition, so these windows and the broadcast have a known bound.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(1))).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranges.withColumns({"end": F.sum("size").over(within), "nth": F.count(F.lit(1)).over(within)})
    placed = placed.join(F.broadcast(offsets), "part")
    shard = F.expr(f"(2 * (bytes_before + end) - size) * {int(shards)} div (2 * all_bytes)")
    placed = placed.select(
        *order, F.least(shard, F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("position"))
    placed = written(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        *order, "shard", (F.col("position") - F.col("first")).alias("slot"))
