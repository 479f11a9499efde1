"""Payloads to observations to star schema, on small payloads written by hand."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import coerce as fn
from tidemark.operators import metrics, star
from tidemark.sources import landing, payloads
from tidemark.streaming import ingest
from tidemark.streaming.ingest import ingest_files

AT = dt.datetime(2024, 5, 1)


def page(rows, **more):
    return json.dumps({"count": 9, "next": "https://x/?page=2", "results": rows, **more})


INDEX = [
    {"listing_id": 1, "title": "A", "kind": "direct_listing", "term": "life_of_rights", "ltm": "100.5", "deal_amount": 1000.0, "deal_date": "2024-01-10T00:00:00.000001Z", "tags": None, "new_key": {"a": [1, "x"]}, "is_nft": False, "seller_id": 7},
    {"listing_id": None, "title": "no id"},
    {"listing_id": 2, "title": "B", "kind": "secondary_listing", "term": "partial_10_year", "ltm": "", "dollar_age": True, "tags": ["t"]},
    {"listing_id": 4, "title": "D", "deal_amount": 0},
]


def detail(**more):
    base = {
        "id": 1, "title": "A2", "minimum_price": "1000", "term": "10_year", "offers_received_count": 3, "unique_bidder_count": 2, "asset": {"id": 50, "royalty_payors": [{"name": "n", "display_name": "d", "kind": "k", "z": 1}]},
        "deal": {"id": 12, "amount": 1000, "buyer_id": 100}, "tags": ["x"], "odd": 5, "active_listing_valuation_id": 3,
        "offers": [{"id": 10, "buyer_id": 100, "amount": "800", "state": "fail_offer_increased"}, {"id": 11, "buyer_id": 101, "amount": 950.5, "state": "fail"}, {"id": 12, "buyer_id": 100, "amount": 1000, "state": "awaiting_transfer"}, {"id": None, "amount": 5}],
        "buy_now_price_history": [{"created_at": "2023-01-01", "buy_now_price": -1}],
        "valuation": {
            "ltm": "100", "three_years_average": 60, "lifetime_amount": 240, "dollar_age": 3.5, "first_earnings_date": "2020-01-01T00:00:00Z",
            "earnings_by_region": [["2023-01-01", {"total": 60, "intl": "1.5"}], ["2023-04-01", {"total": 60}], ["bad", {}], ["2023-07-01"], ["2023-07-01", {"total": 60}], ["2023-10-01", {"total": 60}], ["2023-10-01", {"total": 61}]],
            "top_earnings_by_year": {"top_songs": [{"year": "year_1", "S": 5, "T": "6"}, {"year": "x", "S": 1}, 7], "top_sources": None},
            "top_sources": [{"name": "radio", "earnings": 75, "track_count": 2}, {"name": "web", "earnings": 25}, {"earnings": 0}], "top_songs": [],
            "track_list": [{"id": 5, "parent_id": "", "title": "t"}, {"id": 0}, {"id": "6", "parent_id": 5}],
        },
    }
    return json.dumps({**base, **more})


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame([(page(INDEX), AT)], "payload string, observed_at timestamp")
    third = detail(id=3, offers=[{"id": 1, "buyer_id": 9, "amount": 5, "state": "fail"}], deal={"amount": 90}, asset={"id": 50}, title="C", term=None, minimum_price=None)
    details = spark.createDataFrame([(detail(title="old"), AT - dt.timedelta(days=9)), (detail(), AT), (third, AT), ('{"title": "no id"}', AT), ("not json", AT)], "payload string, observed_at timestamp")
    out = payloads.detail_observations(details)
    return pages, {"index": payloads.index_observations(pages), **out}


def test_index_observations(spark, tables):
    pages, obs = tables
    rows = {r.listing_id: r for r in obs["index"].collect()}
    assert set(rows) == {1, 2, 4}
    assert (rows[1].ltm, rows[1].deal_amount, rows[1].seller_id, rows[1].is_nft, rows[1].tags) == (100.5, 1000.0, 7, False, "[]")
    assert json.loads(rows[1].raw_extra) == {"new_key": {"a": [1, "x"]}}
    assert (rows[2].ltm, rows[2].dollar_age, rows[2].tags) == (None, None, '["t"]') and rows[4].deal_amount == 0.0
    meta = payloads.index_pages(pages).first()
    assert meta.next_url.endswith("page=2") and meta["count"] == 9
    assert sorted(r.listing_id for r in payloads.index_listing_ids(pages).collect()) == [1, 2, 4]
    again = payloads.index_observations(pages)
    assert again.select("obs_id").subtract(obs["index"].select("obs_id")).count() == 0


def test_detail_children(tables):
    _, obs = tables
    new = obs["listing"].filter("title = 'A2'").first()
    assert (new.asset_id, new.ltm, new.deal_offer_id, new.minimum_price, new.valuation_id) == (50, 100.0, 12, 1000.0, 3)
    assert json.loads(new.raw_extra) == {"odd": 5, "active_listing_valuation_id": 3}
    assert json.loads(new.royalty_payors) == [{"name": "n", "display_name": "d", "kind": "k"}]
    mine = lambda t: obs[t].filter(F.col("obs_id") == new.obs_id).collect()
    assert sorted(r.offer_id for r in mine("offer")) == [10, 11, 12]
    assert [(str(r.period_start), r.total) for r in sorted(mine("quarter"), key=lambda r: r.period_start)] == [("2023-01-01", 60.0), ("2023-04-01", 60.0), ("2023-07-01", 60.0), ("2023-10-01", 61.0)]
    assert sorted((r.dimension, r.year_index, r.member, r.amount) for r in mine("year")) == [("song", 1, "S", 5.0), ("song", 1, "T", 6.0)]
    assert sorted((r.member, r.amount, r.track_count) for r in mine("breakdown")) == [("None", 0.0, None), ("radio", 75.0, 2), ("web", 25.0, None)]
    assert sorted((r.track_id, r.parent_track_id) for r in mine("track")) == [("5", None), ("6", "5")]
    assert [(r.seq, r.buy_now_price) for r in mine("buy_now")] == [(0, -1.0)]
    assert obs["rejected"].count() == 2


def test_rebuild(tables):
    _, obs = tables
    out = star.rebuild(obs, F.lit(AT).cast("timestamp"))
    dim = {r.listing_id: r for r in out["dim_listing"].collect()}
    assert set(dim) == {1, 2, 3, 4}
    assert (dim[1].title, dim[1].term_family, dim[1].term_years, dim[1].n_observations, dim[1].has_detail) == ("A2", "fixed_term", 10.0, 3, True)
    assert (dim[2].term_family, dim[2].is_partial_share, dim[2].has_detail, dim[2].asset_id) == ("fixed_term", True, False, None)
    outcome = {r.listing_id: r for r in out["fact_outcome"].collect()}
    first = outcome[1]
    assert (first.second_price, first.opening_price, first.n_bids_by_winner, first.buyer_fee_standard, first.multiple_gross, first.censoring_flag) == (950.5, 800.0, 2, 500.0, 10.0, "left_at_reserve")
    assert (outcome[3].second_price, outcome[3].n_bids_by_winner) == (None, 0)  # nobody is known to have lost
    assert (outcome[2].clearing_price, outcome[2].censoring_flag, outcome[2].outcome_reason, outcome[2].n_bids_by_winner) == (None, "unsold", "no_offers", None)
    assert (outcome[4].sold, outcome[4].buyer_fee_standard, outcome[4].censoring_flag) == (False, 500.0, "none")
    flags = {(r.listing_id, r.flag) for r in out["data_quality_flag"].collect()}
    assert {(2, "missing_ltm"), (2, "secondary_listing"), (4, "no_detail_payload"), (4, "no_earnings_panel"), (1, "ltm_far_above_3yr"), (1, "fee_material_vs_price")} <= flags
    assert (1, "single_bidder") not in flags
    panel = out["fact_earnings_panel"].filter("listing_id = 1").orderBy("period_start").collect()
    assert [r.quarter_index for r in panel] == [0, 1, 2, 3]
    mix = {r.member: r.share for r in out["fact_source_mix"].filter("listing_id = 1").collect()}
    assert mix == {"radio": 0.75, "web": 0.25, "None": 0.0}
    asset = out["dim_asset"].first()
    assert (asset.asset_id, asset.n_listings, asset.n_sold_listings, asset.has_repeat_sale) == (50, 2, 2, True)
    assert out["v_pricing_frame"].count() == 4 and out["v_repeat_sales"].count() == 0
    assert out["v_field_coverage"].agg(F.sum("n")).first()[0] == 4 and out["v_dollar_age_check"].first().n == 2


def test_scalars(spark):
    values = ["", None, "true", "12.5", "x", "1_000", "1d", "nan", "0", "1e400", "-3.9"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.select("i", fn.to_number(F.col("v")).alias("f"), fn.to_integer(F.col("v")).alias("n")).orderBy("i").collect()
    assert [r.f for r in got][:9] == [None, None, None, 12.5, None, None, None, None, 0.0] and got[10].n == -3 and got[9].n is None
    terms = ["life_of_rights", "fixed_return", "30_year", "partial_10_year", None, "", "10_yearly"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, t string")
    got = df.select("i", fn.term_family(F.col("t")).alias("f"), fn.term_years(F.col("t")).alias("y")).orderBy("i").collect()
    assert [(r.f, r.y) for r in got] == [("perpetual", None), ("fixed_return", None), ("fixed_term", 30.0), ("fixed_term", 10.0), ("unknown", None), ("unknown", None), ("unknown", 10.0)]
    got = spark.createDataFrame([(10000.0,), (200000.0,), (None,)], "p double").select(fn.buyer_fee(F.col("p")).alias("f"), fn.buyer_fee(F.col("p"), all_access=True).alias("w")).collect()
    assert [(r.f, r.w) for r in got] == [(500.0, 0.0), (2000.0, 0.0), (None, None)]


def test_normalise_branches(spark):
    rows = [(1, 100.0, 20.0, 90.0, 0.5, 10.0), (2, 100.0, None, None, 0.11, 10.0), (3, 100.0, None, None, 0.10, 10.0), (4, 100.0, None, None, None, 50.0), (5, 150.0, None, None, None, 100.0), (6, 100.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, raw double, spike double, panel double, share double, prior double")
    got = metrics.normalise(df, "raw", "spike", "panel", "share", "prior").orderBy("i").collect()
    assert [r.method for r in got] == ["monthly_sync_spike", "sync_share_cap", "sync_share_cap", "geometric_mean_vs_prior", "none", "none"]
    assert got[0].normalized == 70.0 and got[1].normalized == pytest.approx(99.0) and got[2].excess == 0.0 and got[3].normalized == pytest.approx(5000**0.5)


def test_landing_and_stream(spark, tmp_path):
    folder = str(tmp_path / "landing")
    df = spark.createDataFrame([(page(INDEX),), (page(INDEX),), (page([]),)], "payload string")
    assert landing.land(df, folder).count() == 2
    landing.land(df, folder)
    many = json.dumps({"a": [1, 2], "b": "x"}, indent=2) + "\n"  # lines, and one at the end
    for _ in range(2):
        landing.land(spark.createDataFrame([(many,), (None,), (page([]),)], "payload string"), folder)
    assert sorted(r.payload for r in landing.landed(spark, folder).collect()) == sorted([page(INDEX), page([]), many])
    files = tmp_path / "files" / "a"
    files.mkdir(parents=True)
    (files / "x.json").write_text(many)
    assert [r.payload for r in landing.payload_files(spark, str(files.parent)).collect()] == [many]
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.json").write_text(page(INDEX))
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for _ in range(2):
        ingest_files(spark, str(plain), table, checkpoint, payloads.index_observations)
    (plain / "b.json").write_text(page(INDEX))  # the same payload of the same time again: nothing new
    os.utime(plain / "b.json", ns=(0, (plain / "a.json").stat().st_mtime_ns))
    ingest_files(spark, str(plain), table, checkpoint, payloads.index_observations)
    assert spark.read.parquet(table).count() == 3
    (plain / "c.json").write_text(page(INDEX))  # and of another day: an observation of its own
    later = (plain / "a.json").stat().st_mtime + 2 * 86400
    os.utime(plain / "c.json", (later, later))
    ingest_files(spark, str(plain), table, checkpoint, payloads.index_observations)
    seen = spark.read.parquet(table)
    assert seen.count() == 6 == seen.select("obs_id").distinct().count() and seen.select("observed_on").distinct().count() == 2
    csv = tmp_path / "export.csv"
    csv.write_text(",".join(landing.EXPORT_COLUMNS) + "\r\n" + ",".join("2024" if x == "distribution_year" else "-1.25" if x == "payable_amount" else "" for x in landing.EXPORT_COLUMNS) + "\r\n")
    row = landing.earnings_export(spark, str(csv)).first()
    assert row.distribution_year == 2024 and float(row.payable_amount) == -1.25
    manifest = str(tmp_path / "manifest")
    fetch = spark.createDataFrame([("u", 200), ("v", 404)], "url string, http_status int")
    assert landing.append_manifest(fetch, manifest).select("fetch_id").distinct().count() == 2 == spark.read.parquet(manifest).count()
    made = landing.manifest_rows(spark.createDataFrame([("u", 200)], "url string, http_status int"))
    assert made.columns == [x.split()[0] for x in landing.MANIFEST.split(", ")]


def test_appends_take_every_child_once_and_no_null_key(spark, tables, tmp_path):
    _, obs = tables
    for _ in range(2):
        ingest.append_observations(obs, str(tmp_path))
    for name in ingest.KEYS:
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == obs[name].count() > 0, name
    table = str(tmp_path / "keyed")
    batch = spark.createDataFrame([(None, 1), (None, 2), (3, 4), (3, 4)], "k int, v int")
    for _ in range(2):
        ingest.append_new(batch, table, "k")
    assert [(r.k, r.v) for r in spark.read.parquet(table).collect()] == [(3, 4)]


def test_parsed_once_or_for_each_table_is_the_same(spark, tables, tmp_path):
    details = spark.createDataFrame([(detail(), AT), ("not json", AT), (detail(id=7, deal=None, asset="x"), AT)], "payload string, observed_at timestamp")
    one, each = payloads.detail_observations(details, folder=str(tmp_path)), payloads.detail_observations(details)
    for name, df in each.items():
        assert sorted(map(repr, df.collect())) == sorted(map(repr, one[name].collect())), name
    for df in one.values():
        assert df._jdf.queryExecution().toString().count("payload") < 40  # plans start from what was parsed
    stored = star.rebuild(tables[1], F.lit(AT).cast("timestamp"), folder=str(tmp_path / "star"))
    for name, df in star.rebuild(tables[1], F.lit(AT).cast("timestamp")).items():
        assert sorted(map(repr, df.collect())) == sorted(map(repr, stored[name].collect())), name


def test_arrays_stay_as_they_are_and_short_instants_are_none(spark):
    tracks = [{"id": "0", "title": "text"}, {"id": 0}, {"id": 0.0}, {"id": False}, {"id": ""}, {"id": None}, {"id": []}, {"id": 8}]
    one = detail(tags=[1, "x", None, {"a": 1.5}], media_urls=[{"url": "u"}], published_date="12:30", valuation={"track_list": tracks})
    obs = payloads.detail_observations(spark.createDataFrame([(one, AT), (detail(id=2, tags="x", media_urls=None), AT)], "payload string, observed_at timestamp"))
    first, second = obs["listing"].orderBy("listing_id").collect()
    assert json.loads(first.tags) == [1, "x", None, {"a": 1.5}] and json.loads(first.media_urls) == [{"url": "u"}] and first.published_date is None
    assert (second.tags, second.media_urls) == ("[]", "[]")
    assert sorted(r.track_id for r in obs["track"].filter("listing_id = 1").collect()) == ["0", "8"]
    values = ["12:30", "2024", "2024-05", "2024-05-01", "2024-05-01T10:20:30.5Z", "2024-05-01 10:20:30+02:00", "2024-13-01", "x", "", None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", fn.to_timestamp(F.col("v")).cast("string").alias("t")).orderBy("i")
    assert [r.t for r in df.collect()] == [None] * 3 + ["2024-05-01 00:00:00", "2024-05-01 10:20:30.5", "2024-05-01 08:20:30"] + [None] * 4


def test_repeat_sales_and_reconciliation_from_observations(spark):
    pages = spark.createDataFrame([(page([{"listing_id": i, "deal_date": f"202{i}-01-01T00:00:00Z"} for i in (1, 2, 3)]), AT)], "payload string, observed_at timestamp")
    three = [detail(id=i, asset={"id": 50}, deal={"id": 12, "amount": 1000 * i}) for i in (1, 2, 3)]
    wrong = detail(id=4, offers=[], offers_received_count=2, unique_bidder_count=1, valuation={"ltm": 1, "lifetime_amount": 9, "earnings_by_region": []})
    details = spark.createDataFrame([(x, AT) for x in [*three, wrong]], "payload string, observed_at timestamp")
    obs = payloads.detail_observations(details)
    out = star.rebuild({"index": payloads.index_observations(pages), **obs}, F.lit(AT).cast("timestamp"))
    sales = out["v_repeat_sales"].select("first_sale", "later_sale", "price_ratio", "n_sold_listings").collect()
    assert sorted(map(tuple, sales)) == [(1, 2, 2.0, 4), (1, 3, 3.0, 4), (2, 3, 1.5, 4)]
    found = {r.listing_id: (r.problems, r.reconciles) for r in metrics.reconcile_observations(obs["listing"], obs["offer"], obs["quarter"]).collect()}
    assert found[4] == (["no periods"], False)
    assert found[1] == (["last four periods 241.00, trailing year 100.00"], False)  # 241 is within 2 % of 240


def test_views_frontier_and_one_scan(spark, tables):
    _, obs = tables
    star.publish(star.rebuild(obs, F.lit(AT).cast("timestamp")), "t_")
    assert spark.sql("SELECT count(*) FROM t_v_pricing_frame JOIN t_dim_listing USING (listing_id)").first()[0] == 4
    years = [r.deal_year for r in spark.sql("SELECT deal_year FROM t_v_field_coverage").collect()]
    assert years == sorted(years, key=lambda y: (y is None, y))
    pages = spark.createDataFrame([(f"https://x/?page={i}", page([], next=n)) for i, n in ((1, "https://x/?page=2"), (2, "https://x/?cursor=q"), (9, None))], "url string, payload string")
    assert [r.next_url for r in payloads.frontier(pages).collect()] == ["https://x/?cursor=q"]
    found = metrics.ratio_diagnostics(spark.range(20).selectExpr("double(id) AS a", "double(id % 7) AS b", "if(id < 5, double(id), null) AS c"), "a", {"b": "b", "c": "c"}, "b")
    assert found._jdf.queryExecution().executedPlan().toString().count("Range (") <= 1
    rows = {r.construction: r for r in found.collect()}
    assert (rows["b"].n, rows["c"].n, rows["c"].median_ratio, rows["size"].n) == (20, 5, None, 20)


def test_sums_keep_parts_of_cents_and_take_any_size(spark):
    rows = [("a", 0.004), ("a", 0.004), ("b", 1e17), ("b", 0.5), ("c", 1e200), ("c", 1e200), ("d", None), ("e", -1e16), ("e", 1e16), ("e", 0.25)] + [("f", 0.004)] * 40
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r.t for r in df.groupBy("k").agg(fn.money_sum(F.col("x")).alias("t")).collect()}
    assert got == {"a": 0.008, "b": 1e17 + 0.5, "c": 2e200, "d": None, "e": 0.25, "f": 0.16}
    shares = {(r.k, r.x): r.share for r in metrics.share_of_total(df, ["k"], "x").collect()}
    assert shares["a", 0.004] == 0.5 and shares["c", 1e200] == 0.5 and shares["d", None] is None
    panel = metrics.panel_totals(df.withColumn("p", F.monotonically_increasing_id()), "k", "p", "x")
    assert {r.k: r.panel_total for r in panel.collect()}["f"] == 0.16


def test_messages_round_halves_to_even(spark):
    rows = [(1, 100.0, 20.0, 90.0, None, None, 2, 2.5), (2, 100.0, None, None, 0.125, None, 0, None), (3, 162.5, None, None, None, 100.0, 0, None), (4, 100.0, 1.0, 9.0, None, None, 3, 1003.5)]
    df = spark.createDataFrame(rows, "i int, raw double, spike double, panel double, share double, prior double, n int, med double")
    got = [r.detail for r in metrics.normalise(df, "raw", "spike", "panel", "share", "prior", n_spikes="n", median="med").orderBy("i").collect()]
    assert got[0].endswith("median of 2") and got[1].startswith("share of 12%") and got[2].startswith("+62%") and got[3].endswith("median of 1,004")
