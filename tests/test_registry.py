"""Every registered query that has an oracle, against DuckDB on the same tables."""

import math
import re

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr), sorted(names)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert plain([tuple(r) for r in found.collect()], found.columns) == plain(cursor.fetchall(), names)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(re.fullmatch(r"[a-z0-9_]+", q) for q in e.queries())
