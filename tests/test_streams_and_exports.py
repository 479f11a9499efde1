"""The latest observation by stream, exports with lines that don't fit, and pairs of an asset's sales by date bands."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import star
from tidemark.operators.observations import latest_observation
from tidemark.sources import landing
from tidemark.streaming import latest


def test_late_and_repeated_rows_reach_the_same_latest(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    schema = "k int, at timestamp, id int, v string"
    batches = [
        [(1, at(5), 1, "a"), (2, at(5), 2, "b"), (None, at(9), 3, "none")],
        [(1, at(3), 4, "late"), (2, at(5), 9, "tie"), (3, None, 5, "no instant")],
        [(1, at(4), 6, "late too"), (3, at(1), 7, "c"), (4, at(8), 8, "d")],
    ]
    store = latest.latest_store(spark, f"file://{tmp_path}/store", "k", 4)
    seen = []
    for n, rows in enumerate([*batches, []]):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        seen += rows
        before = store.current()["number"]
        latest.stream_latest(latest.file_stream(spark, f"file://{tmp_path}/in/*", schema), store, f"file://{tmp_path}/checkpoint", "k", "at", "id")
        want = latest_observation(spark.createDataFrame([r for r in seen if r[0] is not None], schema), "k", "at", "id")
        assert sorted(map(str, store.read()["latest"].select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert rows or store.current()["number"] == before  # nothing new: nothing published


def line(**values):
    return ",".join(values.get(c, "") for c in landing.EXPORT_COLUMNS)


def test_lines_that_do_not_fit_are_kept_with_their_reason(spark, tmp_path):
    good = [line(distribution_year="2024", payable_amount="-1.25", track_title='"a, b"'), line(is_adjustment="N"), line(payable_amount="1.005")]
    bad = [line(distribution_year="x"), line() + ",", line()[:-1], line(payable_amount="1,000"), line(distribution_year="2024.5", number_of_plays="many"), "just text"]
    lines = [",".join(landing.EXPORT_COLUMNS), *good[:2], *bad, "", good[2]]
    (tmp_path / "one.csv").write_text("\r\n".join(lines) + "\r\n")
    (tmp_path / "two.csv").write_text(",".join(landing.EXPORT_COLUMNS) + "\r\n")
    rows = landing.earnings_export(spark, str(tmp_path))
    assert rows.columns == landing.EXPORT_COLUMNS
    assert sorted((r.distribution_year or 0, float(r.payable_amount or 0), r.track_title) for r in rows.collect()) == [(0, 0.0, None), (0, 1.01, None), (2024, -1.25, "a, b")]
    assert rows.select("track_title").count() == 3 and rows.agg(F.count("*")).first()[0] == 3  # pruned or not
    out = landing.rejected_earnings(spark, str(tmp_path)).collect()
    assert {r.line: r.reason for r in out} == {
        bad[0]: "distribution_year is not int: x", bad[1]: "33 fields, not 32", bad[2]: "31 fields, not 32", bad[3]: "33 fields, not 32",
        bad[4]: "distribution_year is not int: 2024.5; number_of_plays is not int: many", bad[5]: "1 fields, not 32",
    }
    assert all(r.path.endswith("one.csv") for r in out) and len(out) == len(bad)


def sales(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [(1, i, day(i * i % 97), 1.0 + i, 2.0) for i in range(300)] + [(2, 1000 + i, day(3), 5.0, 1.0) for i in range(120)] + [(2, 2000, day(4), 6.0, None)]
    rows += [(3, 3000, day(1), 1.0, 1.0), (3, 3001, day(2), 3.0, 0.0), (None, 4000, day(1), 1.0, 1.0), (None, 4001, day(9), 1.0, 1.0), (4, 4002, None, 1.0, 1.0), (4, 4003, day(5), 1.0, 1.0)]
    return rows, spark.createDataFrame(rows, "asset int, sale int, date date, price double, size double")


def test_pairs_by_date_bands_are_all_pairs(spark):
    rows, df = sales(spark)
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[2] and b[2] and b[2] > a[2])
    for most in (10, 64, 2000):
        got = star.repeat_pairs(df, "asset", "sale", "date", "price", "size", most=most)
        assert sorted((r.asset, r.first_sale, r.later_sale) for r in got.collect()) == want, most


def test_a_hot_asset_is_cut_into_bands_of_bounded_size(spark):
    _, df = sales(spark)
    dealt = star.date_bands(df.filter("date IS NOT NULL"), "asset", "sale", "date", 20)
    sizes = {(r.asset, r._band): (r["count"], r._bands) for r in dealt.groupBy("asset", "_band", "_bands").count().collect()}
    assert len({b for a, b in sizes if a == 1}) == 15 and len({b for a, b in sizes if a == 2}) == 7  # one day's sales too
    assert max(n for n, _ in sizes.values()) <= 40 and sizes[3, 0] == (2, 1)
    # Bands are in the order of dates.
    ends = {r._band: (r.low, r.high) for r in dealt.filter("asset = 1").groupBy("_band").agg(F.min("date").alias("low"), F.max("date").alias("high")).collect()}
    assert all(ends[b][1] <= ends[b + 1][0] for b in range(14))
