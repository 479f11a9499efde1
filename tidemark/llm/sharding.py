"""Operator 10 (native): contiguous balanced shards from global prefix sums.

Rows are put in a global order (a hash of the text, then the key, so that
equal texts lie together), dealt by range into partitions. Each partition's
total gives the offset of the next; a running sum within a partition then
gives every row's global byte position, and cuts at equal targets give the
shards. The order's last key, a number of the row, splits even rows that are
equal in all and make up a third of the table; the text itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Bytes that a row takes beside its text.
OVERHEAD = 8


def shard(docs: DataFrame, shards: int = 24, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    size is the text's UTF-8 bytes (null: none) plus 8; a row lies in the shard
    that the middle of its bytes falls into, so a shard's bytes differ from the
    target by less than its first and last row. Null keys come first among
    equal texts; repeated rows all get a slot; an empty table gives no rows and
    fewer rows than shards leave shards empty. Other columns are not read."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("crc"),
        F.xxhash64(whole).alias("h"),
    )
    # The number of a row parts rows that are equal in all, however many there are.
    rows = stored(rows.withColumn("nth_row", F.monotonically_increasing_id()))
    order = ["h", "key", "crc", "size", "nth_row"]
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt)
    # One row a partition: bounded by the number of partitions, whatever the input.
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
    )
    upto = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = dealt.withColumns({"end": F.sum("size").over(upto), "nth": F.row_number().over(upto)})
    placed = local.join(F.broadcast(offsets), "part").select(
        "key",
        "size",
        "crc",
        (F.col("rows_before") + F.col("nth") - 1).alias("row"),
        F.expr(f"cast(least({shards - 1}, ((bytes_before + end) * 2 - size) * {shards} div (total * 2)) as int)").alias("shard"),
    )
    placed = stored(placed)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first")).alias("slot")
    )
