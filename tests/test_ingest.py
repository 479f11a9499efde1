"""Appends that read only the partitions of a batch, and files named by what they hold."""

import gzip
import hashlib
import json
import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_star import INDEX, detail, page

from tidemark.sources import landing, payload_sink, payloads
from tidemark.streaming import ingest

NOON = datetime(2024, 3, 5, 12)


def observations(spark, days):
    at = [NOON + timedelta(days=d) for d in days]
    details = payloads.detail_observations(spark.createDataFrame([(detail(), t) for t in at], "payload string, observed_at timestamp"))
    index = payloads.index_observations(spark.createDataFrame([(page(INDEX), t) for t in at], "payload string, observed_at timestamp"))
    return {"index": index, **{k: v for k, v in details.items() if k in ingest.KEYS}}


def filters(df):
    """The partition filters of the scans of a plan."""
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", df._jdf.queryExecution().toString())


@pytest.fixture
def read(monkeypatch):
    """What appends read of tables that are there, by table."""
    found, plain = {}, ingest.existing

    def existing(spark, table, columns, where=None):
        out = plain(spark, table, columns, where)
        if out is not None:
            found[Path(table).name] = out
        return out

    monkeypatch.setattr(ingest, "existing", existing)
    return found


def test_all_tables_are_read_in_the_days_of_the_batch_only(spark, tmp_path, read):
    ingest.append_observations(observations(spark, [0, 1, 2, 3]), str(tmp_path))
    before = {name: spark.read.parquet(f"{tmp_path}/{name}").count() for name in ingest.KEYS}
    assert not read and all(before.values()) and len(before) == 8
    ingest.append_observations(observations(spark, [2, 7]), str(tmp_path))
    for name in ingest.KEYS:
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.count() == before[name] // 4 * 5, name
        assert filters(read[name]) and all("observed_on" in f and " IN (" in f and "2024-03-07" in str(read[name]._jdf.queryExecution()) for f in filters(read[name])), name
        assert read[name].select(F.input_file_name().alias("f")).distinct().filter("f NOT LIKE '%observed_on=2024-03-07%' AND f NOT LIKE '%observed_on=2024-03-12%'").count() == 0


def test_streams_read_the_days_of_a_batch_only(spark, tmp_path, read):
    folder = tmp_path / "files"
    folder.mkdir()
    for n in range(2):
        (folder / f"{n}.json").write_text(page(INDEX))
        ingest.ingest_files(spark, str(folder), str(tmp_path / "table"), str(tmp_path / "checkpoint"), payloads.index_observations)
    assert all("observed_on" in f for f in filters(read["table"])) and filters(read["table"])
    rows = spark.createDataFrame([(i, NOON + timedelta(hours=i)) for i in range(60)], "k int, ts timestamp")
    for n in range(2):
        rows.filter(F.col("k") < 30 * (n + 1)).write.parquet(str(tmp_path / f"rows{n}"))
        ingest.ingest_rows(spark, str(tmp_path / f"rows{n}"), rows.schema, "*.parquet", str(tmp_path / "days"), str(tmp_path / f"checkpoint{n}"), "k", at="ts")
    assert filters(read["days"]) and spark.read.parquet(str(tmp_path / "days")).count() == 60


def test_conditions_hold_for_every_value_of_a_batch(spark, monkeypatch):
    rows = spark.createDataFrame([(1,), (5,), (None,), (5,)], "d int")
    kept = lambda where: sorted(r.d if r.d is not None else -1 for r in spark.createDataFrame([(i,) for i in range(8)] + [(None,)], "d int").filter(where).collect())
    assert kept(ingest.touched(rows, "d")) == [-1, 1, 5]
    assert kept(ingest.touched(rows.dropna(), "d")) == [1, 5]
    assert kept(ingest.touched(rows.filter("d > 9"), "d")) == []
    monkeypatch.setattr(ingest, "MOST_PARTITIONS", 1)
    assert kept(ingest.touched(rows, "d")) == [-1, 1, 2, 3, 4, 5]


def test_shards_of_a_landing_are_pruned(spark, tmp_path, monkeypatch):
    found, plain = [], landing.existing
    monkeypatch.setattr(landing, "existing", lambda *a: found.append(plain(*a)) or found[-1])
    for text in ("a", "b", "a"):
        landing.land(spark.createDataFrame([(text,)], "payload string"), str(tmp_path))
    assert found[0] is None and all("shard" in f and hashlib.sha256(b"a").hexdigest()[:2] in f for f in filters(found[2]))
    assert landing.landed(spark, str(tmp_path)).count() == 2


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*.gz"))


def test_files_are_named_by_their_payloads_and_written_once(spark, tmp_path):
    texts = ["a", "b", "", "lines\r\nand ü\n", "long " * 100_000]
    want = sorted(payload_sink.relative_path(hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    df = spark.createDataFrame([(t,) for t in texts] * 3 + [(None,)], "payload string").repartition(4)
    for _ in range(2):
        landing.land_files(df, f"file://{tmp_path}")
        assert names(tmp_path) == want
    assert sorted(gzip.decompress((tmp_path / n).read_bytes()).decode() for n in want) == sorted(texts)
    totals = [json.loads(p.read_text()) for p in (tmp_path / "_commits").glob("*.json")]
    assert sorted((t["files"], t["there"], t["bytes"]) for t in totals) == [(0, 5, 0), (5, 0, sum(len(t.encode()) for t in texts))]
    assert not list((tmp_path / "_staging").iterdir())
    read = landing.landed_files(spark, f"file://{tmp_path}").collect()
    assert sorted(r.payload for r in read) == sorted(texts) and all(r.intact and r.content_sha256.startswith(r.folder.replace("/", "")) for r in read)
    stamps = {n: (tmp_path / n).stat().st_mtime_ns for n in want}
    spark.createDataFrame([(b"\xff\xfe",), (b"a",)], "raw binary").write.format("payload_files").option("column", "raw").mode("append").save(f"file://{tmp_path}")
    assert len(names(tmp_path)) == 6 and {n: (tmp_path / n).stat().st_mtime_ns for n in want} == stamps


def test_a_failed_job_leaves_whole_files_only(spark, tmp_path):
    payload_sink.register(spark)
    bad = spark.range(40, numPartitions=4).select(F.when(F.col("id") < 39, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("broken")).cast("string")).alias("payload"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("payload_files").mode("append").save(f"file://{tmp_path}")
    for n in names(tmp_path):
        assert payload_sink.relative_path(hashlib.sha256(gzip.decompress((tmp_path / n).read_bytes())).hexdigest()) == n
    assert not (tmp_path / "_commits").exists() and not list((tmp_path / "_staging").glob("*/*"))
    with pytest.raises(Exception, match="only ever added"):
        spark.createDataFrame([("a",)], "payload string").write.format("payload_files").mode("overwrite").save(f"file://{tmp_path}")
