import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm.sharding import shard


def check(rows, docs, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((k is None, k or 0) for k, _ in docs)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    total = sum(r.size for r in rows)
    most = max((r.size for r in rows), default=0)
    for s in range(shards):
        own = by.get(s, [])
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= 1.01 * most
    return by


def test_shards_are_balanced_contiguous_and_complete(spark):
    docs = [(i, "é" * (i * 37 % 501)) for i in range(2000)] + [(5000 + i, "copy " * 20) for i in range(1500)]
    docs += [(None, "x"), (None, "x"), (70007, None), (70007, None), (9000, "long " * 5000)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, shard int, size int")
    rows = shard(df.repartition(7), 24).collect()
    by = check(rows, docs, 24)
    crc = {k: zlib.crc32((t or "").encode()) for k, t in docs if k is not None}
    assert all(r.text_crc32 == crc[r.doc_id] for r in rows if r.doc_id is not None)
    split = defaultdict(set)
    for s, own in by.items():
        for r in own:
            split[r.text_crc32].add(s)
    assert sum(len(x) > 1 for x in split.values()) <= 23  # copies part only at a cut


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert len({r.shard for r in shard(df, 24).collect()}) == 2
    assert shard(df.filter(F.lit(False)), 24).count() == 0


def test_rows_equal_in_all_are_dealt_over_partitions(spark):
    """A third of all rows have no key and one text; no range of the order gets them all."""
    same = spark.range(20000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rest = spark.range(40000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "16k"}
    for k, v in held.items():
        spark.conf.set(k, v)
    rows = shard(same.unionByName(rest), 24)
    # A partition reads at most one file of the placed rows, which is a range of the order.
    ranges = [r["count"] for r in rows.filter("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()]
    for k in held:
        spark.conf.unset(k)
    assert sum(ranges) == 20000 and max(ranges) < 18000
    by = defaultdict(list)
    for r in rows.collect():
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and len(by) == 24
