"""A table of the star schema costs what it is made of, and pairs of sales aren't stored."""

import datetime as dt
import os
import re

from pyspark.sql import functions as F
from test_snapshots import AT, index_row, observed, plain
from test_star import detail

from tidemark.operators import incremental, star
from tidemark.plans import registry
from tidemark.sources import payloads, tables

as_of = lambda: F.lit(AT).cast("timestamp")


def some(spark, n=12):
    details = [detail(id=i, asset={"id": 50 + i % 2}, deal={"id": 12, "amount": 500 + i, "buyer_id": i}) for i in range(1, n)]
    return observed(spark, details, [index_row(i, deal_date=f"2024-01-{1 + i // 2:02}T00:00:00Z") for i in range(1, n)], AT)


def test_a_table_is_made_with_those_that_it_needs_only(spark, tmp_path):
    built = star.rebuild(some(spark), as_of(), folder=str(tmp_path))
    assert not os.listdir(tmp_path)
    built["fact_source_mix"].collect()
    assert os.listdir(tmp_path) == ["latest_listing"]


def test_queries_of_one_table_write_none(spark, monkeypatch):
    monkeypatch.setattr(tables, "write_tables", lambda *a, **b: 1 / 0)
    monkeypatch.setattr(star, "write_tables", lambda *a, **b: 1 / 0)
    for name in ("source_mix", "offers", "outcomes", "pricing", "listings", "flags", "assets", "repeat_sales"):
        assert registry.QUERIES[f"rebuild_{name}"](spark, "/root/testdata/sf0.001").columns


def test_a_payload_is_parsed_once(spark):
    raw = spark.createDataFrame([(detail(), AT)], "payload string, observed_at timestamp")
    plan = payloads.detail_observations(raw)["offer"]._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"from_json\(MapType\([^)]*\), payload#", plan)) == 1


def test_pairs_of_sales_are_not_joined_again(spark):
    built = star.rebuild(some(spark), as_of())
    plan = star.repeat_sales(built["dim_asset"], built["v_pricing_frame"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_i" in next(line for line in plan.splitlines() if "Join" in line)


def test_counts_of_pairs_equal_the_pairs(spark):
    built = star.rebuild(some(spark, 25), as_of())
    pairs = built["v_repeat_sales"].groupBy("asset_id").agg(F.count("*").alias("n_pairs"))
    counts = star.repeat_counts(built["dim_asset"], built["v_pricing_frame"])
    assert plain(counts) == plain(pairs) and len(plain(pairs)) == 2


def test_snapshots_have_pairs_as_a_view(spark, tmp_path):
    one, two = some(spark), observed(spark, [detail(id=20, asset={"id": 50}, deal={"id": 12, "amount": 700})], [index_row(20)], AT + dt.timedelta(days=3))
    store, number = incremental.star_store(spark, f"file://{tmp_path}/star", 8), iter(range(99))
    keep = lambda df, name: tables.write_tables({name: df}, str(tmp_path / f"kept{next(number)}"))[name]
    incremental.full_refresh(store, one, as_of(), str(tmp_path / "scratch1"))
    every = {n: one[n].unionByName(two[n]) for n in one}
    incremental.refresh(store, every, incremental.changed_listings(two), as_of(), keep, str(tmp_path / "scratch2"))
    assert not os.path.exists(tmp_path / "star/v_repeat_sales")
    # What a refresh reads again comes from the store, not from a second copy.
    assert sorted(os.listdir(tmp_path / "scratch1")) == ["latest_index", "latest_listing"]
    want = star.rebuild(every, as_of())
    seen = incremental.views(store.read())
    for name in [*incremental.KEYS, "v_repeat_sales"]:
        assert plain(seen[name]) == plain(want[name]), name
    assert seen["v_repeat_sales"].count() > 0
