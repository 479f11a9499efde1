"""Children of payloads are shuffled once on their way into their tables."""

import re

from pyspark.sql import functions as F
from test_ingest import NOON, observations

from tidemark.streaming import ingest


def test_children_of_a_day_are_shuffled_once(spark, tmp_path, monkeypatch):
    plans = {}
    monkeypatch.setattr(ingest, "append_new", lambda rows, table, keys, **more: plans.update({table.rpartition("/")[2]: (rows, rows.dropDuplicates(keys)._jdf.queryExecution().executedPlan().toString())}))
    ingest.append_observations(observations(spark, [0]), str(tmp_path))
    for name in ("offer", "quarter", "breakdown", "track"):
        rows, plan = plans[name]
        assert "Join" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) == 1, name
        assert {str(r[0]) for r in rows.select(ingest.DAY).collect()} == {str(NOON.date())}, name


def test_days_of_a_larger_batch_are_those_of_the_listings(spark, tmp_path):
    obs = observations(spark, [0, 1])
    ingest.append_observations(obs, str(tmp_path))
    days = spark.read.parquet(f"{tmp_path}/listing").select("obs_id", ingest.DAY)
    offers = spark.read.parquet(f"{tmp_path}/offer")
    assert offers.count() == obs["offer"].count() == offers.join(days, ["obs_id", ingest.DAY]).count() > 0
    assert offers.select(F.count_distinct(ingest.DAY)).first()[0] == 2
