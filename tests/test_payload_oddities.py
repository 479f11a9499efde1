"""Children that aren't what they should be, by themselves and among good ones."""

import datetime as dt

import pytest
from test_star import detail

from tidemark.sources import payloads

AT = dt.datetime(2024, 5, 1)
OFFER = {"id": 10, "buyer_id": "100", "amount": "800.50", "state": "fail", "kind": {"odd": [1]}, "incentive_pool_qualifying": True, "created_at": "2024-01-02T03:04:05Z"}


def children(spark, name, **more):
    df = spark.createDataFrame([(detail(**more), AT)], "payload string, observed_at timestamp")
    return payloads.detail_observations(df)[name].collect()


@pytest.mark.parametrize("among", [[], [7], [None], ["x"], [[1]], [{}], [True, {"id": "x"}, {"id": False}]])
def test_offers_among_other_elements(spark, among):
    (r,) = children(spark, "offer", offers=[*among, {**OFFER, "amount": 1}, *among, OFFER])  # of one id the last stays
    assert (r.offer_id, r.buyer_id, r.amount, r.kind, r.incentive_pool_qualifying, str(r.created_at)[:10]) == (10, 100, 800.5, '{"odd":[1]}', True, "2024-01-02")


@pytest.mark.parametrize("offers", [None, {}, {"id": 1}, "x", 5, [], [[]], True])
def test_no_list_has_no_offers(spark, offers):
    assert children(spark, "offer", offers=offers) == []


def test_other_children(spark):
    history = children(spark, "buy_now", buy_now_price_history=[7, {"buy_now_price": "12.5"}, {"created_at": "2023-01-01", "buy_now_price": -1}])
    assert sorted((r.seq, r.buy_now_price) for r in history) == [(0, None), (1, 12.5), (2, -1.0)]
    value = {
        "track_list": [{"id": 5, "title": "t"}, {"id": "0"}, {"id": 0}, {"id": False}, {"id": []}, {"id": {}}, {"id": ""}, {"id": None}, {"title": "none"}, 9, {"id": "a", "parent_id": ""}, {"id": "a", "parent_id": "p"}, {"id": 1.5}],
        "top_sources": [3, {"name": None, "earnings": "1"}, {"name": "radio", "earnings": True, "track_count": "4"}, {"name": 7, "earnings": 2.5}],
        "top_earnings_by_year": {"top_songs": [3, {"year": "year_2", "A": "1", "B": None}, {"year": 4, "C": 5}, {"D": 1}, [1]], "top_income_types": "x"},
        "earnings_by_region": [["2023-01-01", {"total": "60"}], ["2023-04-01", 5], ["2023-07-01", {"intl": 1}, 3], [], "x", ["x", {}], ["2023-10-01T00:00:00Z", {"total": True}]],
    }
    assert sorted((r.track_id, r.parent_track_id) for r in children(spark, "track", valuation=value)) == [("0", None), ("1.5", None), ("5", None), ("a", "p")]
    assert sorted((r.member, r.amount, r.track_count) for r in children(spark, "breakdown", valuation=value)) == [("7", 2.5, None), ("None", 1.0, None), ("radio", None, 4)]
    assert sorted((r.year_index, r.member, r.amount) for r in children(spark, "year", valuation=value)) == [(2, "A", 1.0), (2, "B", None), (4, "C", 5.0)]
    assert sorted((str(r.period_start), r.total) for r in children(spark, "quarter", valuation=value)) == [("2023-01-01", 60.0), ("2023-10-01", None)]
    for name in ("track", "breakdown", "year", "quarter"):
        assert children(spark, name, valuation=[value]) == [] == children(spark, name, valuation=None)


def test_a_list_of_objects_is_parsed_at_once(spark):
    plan = payloads.detail_observations(spark.createDataFrame([(detail(), AT)], "payload string, observed_at timestamp"))["offer"]._jdf.queryExecution().toString()
    assert "array<struct" in plan.lower() or "StructField(buyer_id" in plan or "buyer_id,StringType" in plan
