"""Refreshes that are seen whole or not at all, and refreshes of what has changed only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_star import detail

from tidemark.operators import incremental
from tidemark.sources import files, payloads, tables
from tidemark.sources.snapshots import RefreshConflict, SnapshotStore

AT = dt.datetime(2024, 5, 1)


def store_of(spark, tmp_path, buckets=4):
    return SnapshotStore(spark, f"file://{tmp_path}/store", {"a": "k", "b": "k", "c": "k"}, buckets)


def three(spark, n, text):
    df = spark.range(n).select(F.col("id").alias("k"), F.lit(text).alias("v"))
    return {"a": df, "b": df, "c": df.filter("k > 0")}


def rows(tables):
    return {name: sorted((r.k, r.v) for r in tables[name].collect()) for name in tables}


def test_a_refresh_that_dies_leaves_the_tables_as_they_were(spark, tmp_path):
    store = store_of(spark, tmp_path)
    assert store.current()["number"] == 0 and not list(store.read())
    store.publish(three(spark, 20, "old"))
    before, opened = rows(store.read()), store.read()
    broken = three(spark, 20, "new")
    broken["c"] = broken["c"].withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("killed")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="killed"):
        store.publish(broken)  # a and b are written by then
    assert len(files.names(spark, f"{store.folder}/a/bucket=0")) == 2
    assert rows(store.read()) == before == rows(opened)
    store.expire(1)
    assert len(files.names(spark, f"{store.folder}/a/bucket=0")) == 1 and rows(store.read()) == before
    store.publish(three(spark, 5, "new"))
    assert rows(opened) == before  # who has begun to read goes on
    assert rows(store.read()) == rows(three(spark, 5, "new"))


def test_of_two_refreshes_at_once_one_fails(spark, tmp_path):
    store = store_of(spark, tmp_path)
    base = store.publish(three(spark, 9, "one"))
    store.publish({"a": three(spark, 9, "two")["a"]}, base=base)
    with pytest.raises(RefreshConflict):
        store.publish({"b": three(spark, 9, "three")["b"]}, base=base)
    seen = store.read()
    assert [{r.v for r in seen[n].collect()} for n in ("a", "b", "c")] == [{"two"}, {"one"}, {"one"}]
    assert not files.write_new(spark, f"{store.folder}/_snapshots/000000000002.json", "x") and store.current()["number"] == 2


def test_touched_buckets_are_replaced_others_stay(spark, tmp_path):
    store = store_of(spark, tmp_path, buckets=16)
    first = store.publish(three(spark, 40, "old"))
    fresh = three(spark, 3, "new")["a"]
    second = store.publish({"a": fresh}, {"a": store.touched(fresh, "k")})
    buckets = store.touched(fresh, "k")
    assert {b for b, v in second["tables"]["a"]["live"].items() if first["tables"]["a"]["live"].get(b) != v} == {str(b) for b in buckets}
    assert sorted(r.k for r in store.read()["a"].filter("v = 'new'").collect()) == [0, 1, 2]
    some = store.read(where={"a": buckets})["a"]
    assert some.filter("v = 'old'").count() == 0 and some.count() == 3
    store.publish({"a": fresh.filter("k > 9")}, {"a": buckets})
    assert store.read()["a"].filter("v = 'new'").count() == 0
    store.publish({n: df.filter("k > 99") for n, df in three(spark, 1, "x").items()})
    assert all(store.read()[n].count() == 0 and store.read()[n].columns == ["k", "v"] for n in "abc")


def index_row(listing, **more):
    return {"listing_id": listing, "title": f"T{listing}", "ltm": "100", "deal_date": "2024-01-10T00:00:00Z", "deal_amount": 100 * (listing or 0), **more}


def observed(spark, details, index, at):
    import json

    obs = payloads.detail_observations(spark.createDataFrame([(d, at) for d in details], "payload string, observed_at timestamp"))
    page = spark.createDataFrame([(json.dumps({"results": index}), at)], "payload string, observed_at timestamp")
    return {name: obs[name] for name in ("listing", "offer", "quarter", "breakdown")} | {"index": payloads.index_observations(page)}


def plain(df):
    return sorted((str(r.asDict()) for r in df.select(*sorted(df.columns)).collect()))


def test_a_refresh_equals_a_rebuild_and_leaves_other_buckets_alone(spark, tmp_path):
    new = detail(id=20, asset={"id": 51}, deal={"id": 12, "amount": 700, "buyer_id": 1})
    moved = detail(id=3, asset={"id": 60}, offers=[], title="moved")  # its asset had it before
    one = observed(spark, [detail(id=i, asset={"id": 50 + i % 3}, deal={"id": 12, "amount": 500 + i, "buyer_id": i}) for i in range(1, 8)], [index_row(i, deal_date=f"2024-01-{i:02}T00:00:00Z") for i in range(1, 12)], AT)
    two = observed(spark, [new, moved], [index_row(20), index_row(5, title="renamed"), index_row(None)], AT + dt.timedelta(days=3))
    number = iter(range(10**6))
    keep = lambda df, name: tables.write_tables({name: df}, str(tmp_path / f"kept{next(number)}"))[name]
    one, two = ({n: keep(df, n) for n, df in batch.items()} for batch in (one, two))
    every = {n: one[n].unionByName(two[n]) for n in one}
    as_of = F.lit(AT).cast("timestamp")
    store = incremental.star_store(spark, f"file://{tmp_path}/star", 32)
    first = incremental.full_refresh(store, one, as_of, str(tmp_path / "scratch1"))
    changed = incremental.changed_listings(two)
    assert sorted(r.listing_id for r in changed.collect()) == [3, 5, 20]
    second = incremental.refresh(store, every, changed, as_of, keep, str(tmp_path / "scratch2"))
    want = incremental.star.rebuild(every, as_of, folder=str(tmp_path / "scratch3"))
    seen = incremental.views(store.read())
    for name in [*incremental.KEYS, "v_field_coverage", "v_dollar_age_check"]:
        assert plain(seen[name]) == plain(want[name]), name
    rewritten = {b for b, v in second["tables"]["dim_listing"]["live"].items() if first["tables"]["dim_listing"]["live"].get(b) != v}
    assert rewritten == {str(b) for b in store.touched(changed, "listing_id")}
    assert seen["v_repeat_sales"].count() > 0 and sorted(r.asset_id for r in seen["dim_asset"].collect()) == [50, 51, 52, 60]
