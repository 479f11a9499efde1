"""Registered queries of the catalogue operators on the driver's tables, with DuckDB oracles.

The driver's tables stand in for the domain's: an order is a listing, its lines
are bids or income, a customer is an asset, events are monthly income. Money is
summed in decimals so that a result doesn't depend on the order of rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import coerce as fn
from tidemark.operators import flags, incremental, ladder, metrics, observations, star
from tidemark.session import shared_folder
from tidemark.sources import landing, payloads, tables
from tidemark.streaming import ingest, latest

QUERIES = {}
ORACLES = {}
c = F.col


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def day(name: str):
    return c(name).cast("date")


def iso(name: str):
    """A date as text: alike in every engine."""
    return day(name).cast("string").alias(name)


# -- observations ---------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, o_totalprice, n_obs, first_obs::DATE::VARCHAR AS first_obs, last_obs::DATE::VARCHAR AS last_obs FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n_obs,
         min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_obs, max(o_orderdate) OVER (PARTITION BY o_custkey) AS last_obs FROM orders) WHERE rn = 1""")
def latest_observation(spark, sf):
    found = observations.latest_observation(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return found.select("o_custkey", "o_orderkey", "o_totalprice", "n_obs", iso("first_obs"), iso("last_obs"))


@query("""WITH i AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0),
d AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(i.k, d.k) AS k, coalesce(d.v, i.v) AS v, least(d.v, i.v) AS low, greatest(d.v, i.v) AS high, d.k IS NOT NULL AS has_detail
FROM i FULL OUTER JOIN d ON i.k = d.k""")
def spine_full_outer(spark, sf):
    i = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(c("c_custkey").alias("k"), c("c_acctbal").alias("v"))
    d = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    dv, iv = c("d")["v"], c("i")["v"]
    return star.spine(i, d, "k").select("k", star.first_of("v").alias("v"), F.least(dv, iv).alias("low"), F.greatest(dv, iv).alias("high"), c("d").isNotNull().alias("has_detail"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""")
def keep_last_upsert(spark, sf):
    found = observations.keep_last(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return found.select("l_orderkey", c("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice")


@query("""SELECT sha256(text) AS content_sha256, min(doc_id) AS first_key, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def content_hash_dedupe(spark, sf):
    return observations.distinct_payloads(table(spark, sf, "documents"), "text", "doc_id")


@query("""WITH latest AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey, l_orderkey, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total
FROM latest JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def children_of_latest(spark, sf):
    latest = observations.latest_observation(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    lines = table(spark, sf, "lineitem").join(latest.select("o_custkey", c("o_orderkey").alias("l_orderkey")), "l_orderkey")
    lines = lines.join(table(spark, sf, "customer").select(c("c_custkey").alias("o_custkey")), "o_custkey")
    return lines.groupBy("o_custkey", "l_orderkey").agg(F.count("*").alias("n"), fn.money_sum(c("l_extendedprice")).alias("total"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def anti_join(spark, sf):
    lines = table(spark, sf, "lineitem").select(c("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey", "o_totalprice")


# -- ladders and outcomes ---------------------------------------------------------


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice NULLS LAST, l_partkey, l_suppkey, l_linenumber) AS ladder_rank FROM lineitem""")
def ladder_rank(spark, sf):
    ranked = ladder.rank_ladder(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")
    return ranked.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "ladder_rank")


def bids(spark, sf) -> DataFrame:
    """Lines as bids; the highest of an order wins."""
    best = F.max("l_extendedprice").over(W.partitionBy("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", (c("l_extendedprice") == best).alias("won"))


LADDER = """bids AS (SELECT l_orderkey, list(struct_pack(s := l_suppkey, a := l_extendedprice)) AS bids, max(l_extendedprice) AS top FROM lineitem GROUP BY 1),
ladder AS (SELECT l_orderkey, list_min([b.s for b in bids if b.a = top]) AS winner, list_max([b.a for b in bids if b.a < top]) AS second_price, list_min([b.a for b in bids]) AS opening_price,
  len([b for b in bids if b.s = list_min([x.s for x in bids if x.a = top])])::BIGINT AS n_bids_by_winner, len(bids)::BIGINT AS n_bids FROM bids)"""


@query(f"WITH {LADDER} SELECT * FROM ladder")
def ladder_summary(spark, sf):
    return ladder.summarise_ladder(bids(spark, sf), "l_orderkey", "l_suppkey", "l_extendedprice", "won")


@query("""WITH b AS (SELECT l_orderkey, l_suppkey, l_extendedprice,
  (CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'awaiting_transfer' ELSE 'open' END = 'awaiting_transfer')
   OR (l_partkey = CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE max(l_partkey) OVER (PARTITION BY l_orderkey) END) AS won FROM lineitem),
w AS (SELECT l_orderkey, min(l_suppkey) FILTER (won) AS winner FROM b GROUP BY 1)
SELECT l_orderkey, any_value(winner) AS winner, max(l_extendedprice) FILTER (NOT won) AS second_price, count(*) FILTER (l_suppkey = winner) AS n_bids_by_winner FROM b JOIN w USING (l_orderkey) GROUP BY 1""")
def three_valued_winner(spark, sf):
    deal = F.when(c("l_orderkey") % 3 != 0, F.max("l_partkey").over(W.partitionBy("l_orderkey")))
    state = F.when((c("l_returnflag") == "R") & (c("l_linestatus") == "F"), "awaiting_transfer").otherwise("open")
    offers = table(spark, sf, "lineitem").withColumn("deal", deal).withColumn("won", ladder.winning(state, c("l_partkey"), c("deal")))
    return ladder.summarise_ladder(offers, "l_orderkey", "l_suppkey", "l_extendedprice", "won").select("l_orderkey", "winner", "second_price", "n_bids_by_winner")


def priced_orders(spark, sf) -> DataFrame:
    """Orders as listings: open ones have no price, some went at their reserve or for nothing."""
    o = table(spark, sf, "orders")
    spent = o.groupBy("o_custkey").agg(fn.money_sum(c("o_totalprice")).alias("ltm"), F.max("o_totalprice").alias("top"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_offers"))
    price = F.when(c("o_orderkey") % 11 == 0, 0.0).when(c("o_orderstatus") != "O", c("o_totalprice"))
    base = o.join(spent, "o_custkey").join(lines, o.o_orderkey == lines.l_orderkey, "left").drop("l_orderkey")
    return base.select(
        c("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderpriority", price.alias("price"), "ltm", c("top").alias("three_years_average"), F.nullif(c("o_orderkey") % 5, F.lit(0)).cast("double").alias("median_multiplier"),
        F.when(c("o_orderkey") % 7 == 0, c("o_totalprice")).alias("minimum_price"), "n_offers",
    )


PRICED = """spent AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS ltm, max(o_totalprice) AS top FROM orders GROUP BY 1),
n AS (SELECT l_orderkey, count(*) AS n_offers FROM lineitem GROUP BY 1),
priced AS (SELECT o_orderkey AS l_orderkey, o_custkey, o_orderdate, o_orderpriority, CASE WHEN o_orderkey % 11 = 0 THEN 0.0::DOUBLE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS price, ltm, top AS three_years_average,
  nullif(o_orderkey % 5, 0)::DOUBLE AS median_multiplier, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice END AS minimum_price, n_offers
  FROM orders JOIN spent USING (o_custkey) LEFT JOIN n ON l_orderkey = o_orderkey)"""


def quotient_sql(over: str, under: str) -> str:
    """A quotient of two columns; null where there is nothing to divide by."""
    return f"CASE WHEN {under} <> 0 THEN {over} / {under} END"


def outcome_sql(fee: str) -> str:
    """Outcomes by cases: an order's states are looked up in two small tables of what they are called."""
    return f"""WITH {LADDER}, {PRICED},
reasons(sold, offered, outcome_reason) AS (VALUES (true, true, 'sold'), (true, false, 'sold'), (false, true, 'unknown'), (false, false, 'no_offers')),
censors(closed, at_floor, censoring_flag) AS (VALUES (true, true, 'left_at_reserve'), (true, false, 'none'), (false, true, 'unsold'), (false, false, 'unsold')),
deals AS (SELECT p.*, {fee} AS standard_fee, price IS NOT NULL AS closed, ifnull(price, 0) > 0 AS sold, ifnull(n_offers, 0) > 0 AS offered,
  ifnull(abs(minimum_price - price), 1) < 1e-6 AS at_floor FROM priced p),
paid AS (SELECT *, CASE WHEN closed THEN standard_fee END AS buyer_fee_standard, CASE WHEN closed THEN price + standard_fee END AS all_in_cost, {quotient_sql("price", "ltm")} AS multiple_gross FROM deals)
SELECT l_orderkey, sold, outcome_reason, buyer_fee_standard, price - second_price AS winner_margin_over_second, n_bids_by_winner, all_in_cost, multiple_gross, censoring_flag,
  {quotient_sql("all_in_cost", "ltm")} AS multiple_all_in, {quotient_sql("price", "three_years_average")} AS multiple_normalized, {quotient_sql("multiple_gross", "median_multiplier")} AS multiple_vs_median
FROM paid JOIN reasons USING (sold, offered) JOIN censors USING (closed, at_floor) LEFT JOIN ladder USING (l_orderkey)"""


OUTCOME = ["l_orderkey", "sold", "outcome_reason", "buyer_fee_standard", "winner_margin_over_second", "n_bids_by_winner", "all_in_cost", "multiple_gross", "multiple_all_in", "multiple_normalized", "multiple_vs_median", "censoring_flag"]


@query(outcome_sql("greatest(500.0::DOUBLE, price * 0.01::DOUBLE)"))
def outcome_multiples(spark, sf):
    return star.outcome(priced_orders(spark, sf), ladder_summary(spark, sf), "l_orderkey").select(*OUTCOME)


@query(outcome_sql("0.0::DOUBLE"))
def outcome_all_access(spark, sf):
    return star.outcome(priced_orders(spark, sf), ladder_summary(spark, sf), "l_orderkey", all_access=True).select(*OUTCOME)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0.0::DOUBLE ELSE greatest(500.0::DOUBLE, o_totalprice * 0.01::DOUBLE) END AS fee,
  CASE WHEN o_orderstatus = 'O' THEN 0.0::DOUBLE ELSE greatest(500.0::DOUBLE, o_totalprice * 0.01::DOUBLE) END AS fee_null_price FROM orders""")
def fee_waivers(spark, sf):
    open_price = F.when(c("o_orderstatus") != "O", c("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", fn.buyer_fee(c("o_totalprice"), opened_bidding=c("o_orderkey") % 2 == 0).alias("fee"), fn.buyer_fee(open_price, null_price=0.0).alias("fee_null_price"))


# -- panels, shares, assets ---------------------------------------------------------


@query("""WITH m AS (SELECT l_orderkey, l_returnflag, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount FROM lineitem GROUP BY 1, 2)
SELECT *, amount / nullif(sum(amount::DECIMAL(18,2)) OVER (PARTITION BY l_orderkey)::DOUBLE, 0) AS share FROM m""")
def source_mix_share(spark, sf):
    mix = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(fn.money_sum(c("l_extendedprice")).alias("amount"))
    return metrics.share_of_total(mix, ["l_orderkey"], "amount")


@query("""WITH m AS (SELECT l_orderkey, l_suppkey, l_extendedprice / 1e7::DOUBLE AS amount FROM lineitem WHERE l_suppkey % 3 = 0), t AS (SELECT l_orderkey, sum(amount::DECIMAL(28,10))::DOUBLE AS total FROM m GROUP BY 1)
SELECT l_orderkey, l_suppkey, round(amount / nullif(total, 0), 6) AS share, round(total, 9) AS total FROM m JOIN t USING (l_orderkey)""")
def small_amounts(spark, sf):
    """Amounts below a cent: their shares and totals."""
    m = table(spark, sf, "lineitem").filter("l_suppkey % 3 = 0").select("l_orderkey", "l_suppkey", (c("l_extendedprice") / 1e7).alias("amount"))
    shared = metrics.share_of_total(m, ["l_orderkey"], "amount").withColumn("total", fn.money_sum(c("amount"), W.partitionBy("l_orderkey")))
    return shared.select("l_orderkey", "l_suppkey", F.round("share", 6).alias("share"), F.round("total", 9).alias("total"))


@query("""WITH q AS (SELECT l_suppkey, date_trunc('quarter', l_shipdate)::DATE AS period, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, period::VARCHAR AS period, total, (datediff('month', min(period) OVER (PARTITION BY l_suppkey), period) // 3)::BIGINT AS quarter_index,
  datediff('day', DATE '1995-01-01' + (l_suppkey % 400)::INTEGER, period) / 91.31::DOUBLE AS quarters_before_listing FROM q""")
def quarterly_panel(spark, sf):
    q = table(spark, sf, "lineitem").groupBy("l_suppkey", F.date_trunc("quarter", "l_shipdate").cast("date").alias("period")).agg(fn.money_sum(c("l_extendedprice")).alias("total"))
    q = q.withColumn("deal", F.date_add(F.lit("1995-01-01").cast("date"), (c("l_suppkey") % 400).cast("int")))
    return star.earnings_panel(q, "l_suppkey", "period", "deal").select("l_suppkey", iso("period"), "total", "quarter_index", "quarters_before_listing")


@query("""WITH q AS (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS period FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, period::VARCHAR AS period, round(datediff('month', min(period) OVER (PARTITION BY l_suppkey), period) / 3.0::DOUBLE)::BIGINT AS quarter_index FROM q""")
def monthly_panel(spark, sf):
    """Months that aren't whole quarters from the first one: their index is rounded."""
    q = table(spark, sf, "lineitem").select("l_suppkey", F.date_trunc("month", "l_shipdate").cast("date").alias("period")).distinct()
    found = star.earnings_panel(q.withColumn("deal", F.lit(None).cast("date")), "l_suppkey", "period", "deal")
    return found.select("l_suppkey", iso("period"), "quarter_index")


@query("""SELECT o_custkey AS asset_id, min_by(o_orderpriority, o_orderkey) AS title, count(*) AS n_listings, count(*) FILTER (o_orderstatus = 'F') AS n_sold_listings,
  min(o_orderdate)::DATE::VARCHAR AS first_published, max(o_orderdate)::DATE::VARCHAR AS last_published, count(*) FILTER (o_orderstatus = 'F') > 1 AS has_repeat_sale FROM orders GROUP BY 1""")
def asset_rollup(spark, sf):
    o = table(spark, sf, "orders")
    dim = o.select(c("o_orderkey").alias("listing_id"), c("o_custkey").alias("asset_id"), c("o_orderpriority").alias("title"), day("o_orderdate").alias("published_date"))
    found = star.dim_asset(dim, o.select(c("o_orderkey").alias("listing_id"), (c("o_orderstatus") == "F").alias("sold")))
    return found.withColumns({x: iso(x) for x in ("first_published", "last_published")})


@query("""WITH s AS (SELECT o_custkey, o_orderkey AS sale, o_orderdate::DATE AS date, o_totalprice AS price, nullif(o_orderkey % 4, 0)::DOUBLE AS size FROM orders WHERE o_orderstatus = 'F')
SELECT a.o_custkey, a.sale AS first_sale, b.sale AS later_sale, datediff('day', a.date, b.date) / 365.25::DOUBLE AS years_held, b.size / a.size AS size_ratio, b.price / nullif(a.price, 0) AS price_ratio
FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND b.date > a.date""")
def repeat_pairs(spark, sf):
    sold = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", day("o_orderdate").alias("date"), "o_totalprice", F.nullif(c("o_orderkey") % 4, F.lit(0)).cast("double").alias("size"))
    pairs = star.repeat_pairs(sold, "o_custkey", "o_orderkey", "date", "o_totalprice", "size")
    return pairs.select("o_custkey", "first_sale", "later_sale", "years_held", "size_ratio", "price_ratio")


# -- flags, frames, coverage ------------------------------------------------------------

ORDER_RULES = [
    flags.Rule("missing_price", "exclude", "no price, or none above zero", "price IS NULL OR price <= 0"),
    flags.Rule("urgent", "exclude", "urgent", "o_orderpriority = '1-URGENT'"),
    flags.Rule("no_lines", "warn", "no lines", "n_offers IS NULL"),
    flags.Rule("far_above_top", "info", "above nine tenths of the customer's largest", "three_years_average > 0 AND price / nullif(three_years_average, 0D) > 0.9"),
    flags.Rule("above_reserve", "warn", "above its reserve", "price IS NOT NULL AND minimum_price IS NOT NULL AND price > minimum_price + 0.51"),
    flags.Rule("one_line", "warn", "one line", "n_offers = 1"),
    flags.Rule("fee_material_vs_price", "warn", "fee above two percent", "greatest(500D, price * 0.01D) > 0.02D * price"),
]
FLAGS_SQL = "flags AS (" + " UNION ALL ".join(
    f"SELECT l_orderkey, '{r.flag}' AS flag, '{r.severity}' AS severity FROM priced WHERE "
    + r.when.replace("500D", "500::DOUBLE").replace("0.01D", "0.01::DOUBLE").replace("0.02D", "0.02::DOUBLE").replace("0D", "0::DOUBLE")
    for r in ORDER_RULES
) + ")"


@query(f"WITH {PRICED}, {FLAGS_SQL} SELECT * FROM flags")
def quality_flags(spark, sf):
    return flags.flag_rows(priced_orders(spark, sf), "l_orderkey", ORDER_RULES).select("l_orderkey", "flag", "severity")


@query(f"""WITH {LADDER}, {PRICED}, {FLAGS_SQL}
SELECT l_orderkey, o_custkey, date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS deal_quarter, ltm / nullif(three_years_average, 0) AS ltm_vs_3yr, price, second_price,
  (SELECT count(*) FROM flags q WHERE q.l_orderkey = p.l_orderkey AND severity = 'exclude') AS n_exclude_flags FROM priced p LEFT JOIN ladder USING (l_orderkey)""")
def pricing_frame(spark, sf):
    base = priced_orders(spark, sf).withColumn("n", flags.n_flags(ORDER_RULES, "exclude"))
    wide = base.join(ladder_summary(spark, sf), "l_orderkey", "left")
    return wide.select("l_orderkey", "o_custkey", F.date_trunc("quarter", "o_orderdate").cast("date").cast("string").alias("deal_quarter"), fn.ratio(c("ltm"), c("three_years_average")).alias("ltm_vs_3yr"), "price", "second_price", c("n").alias("n_exclude_flags"))


@query(f"""WITH {PRICED} SELECT date_trunc('year', o_orderdate)::DATE::VARCHAR AS deal_year, o_orderpriority AS kind, count(*) AS n, sum(CASE WHEN price > 0 THEN 1 ELSE 0 END)::BIGINT AS n_sold,
  avg(CASE WHEN price IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS cov_price, avg(CASE WHEN n_offers IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS cov_n_offers FROM priced GROUP BY 1, 2""")
def field_coverage(spark, sf):
    found = star.field_coverage(priced_orders(spark, sf).withColumn("sold", c("price") > 0), "o_orderdate", "o_orderpriority", "sold", ["price", "n_offers"])
    return found.withColumn("deal_year", iso("deal_year"))


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN round(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})), 6) END"


@query(f"""SELECT count(*) AS n, {_corr("l_discount", "ln(l_quantity)")} AS corr_with_log_size, {_corr("l_discount", "l_tax")} AS corr_with_age,
  count(*) FILTER (l_discount > l_tax + 0.51) AS n_exceeds_age, median(l_discount) AS median_reported, max(l_discount) AS max_reported FROM lineitem WHERE l_discount IS NOT NULL AND l_quantity > 0""")
def correlation_check(spark, sf):
    found = star.age_check(table(spark, sf, "lineitem"), "l_discount", "l_quantity", "l_tax")
    return found.withColumns({x: F.round(x, 6) for x in ("corr_with_log_size", "corr_with_age")})


# -- numeric operators ----------------------------------------------------------------------


@query("""SELECT p_brand, CASE WHEN sum(p_retailprice::DECIMAL(28,6)) > 0 THEN sum((p_size * p_retailprice)::DECIMAL(28,6))::DOUBLE / sum(p_retailprice::DECIMAL(28,6))::DOUBLE END AS weighted_average,
  sum((p_size * p_retailprice)::DECIMAL(28,6))::DOUBLE AS weighted_total FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL GROUP BY 1""")
def weighted_age(spark, sf):
    return metrics.weighted_age(table(spark, sf, "part"), ["p_brand"], "p_size", "p_retailprice")


def _diagnosis(name: str, column: str) -> str:
    r = f"l_extendedprice / nullif({column}, 0)"
    return f"""SELECT '{name}' AS construction, count(*) AS n, round(quantile_cont({r}, 0.5), 6) AS median_ratio, round(quantile_cont({r}, 0.75) - quantile_cont({r}, 0.25), 6) AS iqr_ratio,
  {_corr("l_extendedprice", column)} AS corr FROM lineitem"""


@query(f"""{_diagnosis("by_quantity", "l_quantity")} UNION ALL {_diagnosis("by_discount", "l_discount")}
UNION ALL SELECT 'size', count(*), NULL, NULL, {_corr("l_extendedprice", "ln(greatest(l_tax, 1.0::DOUBLE) + 0 * l_tax)").replace("ln(greatest(l_tax, 1.0::DOUBLE) + 0 * l_tax)", "ln(greatest(l_quantity, 1.0::DOUBLE))")} FROM lineitem""")
def ratio_diagnostics(spark, sf):
    found = metrics.ratio_diagnostics(table(spark, sf, "lineitem"), "l_extendedprice", {"by_quantity": "l_quantity", "by_discount": "l_discount"}, "l_quantity")
    return found.withColumns({x: F.round(x, 6) for x in ("median_ratio", "iqr_ratio", "corr")})


SPIKES = """m AS (SELECT user_id, median(value) AS median FROM events WHERE event_type = 'purchase' GROUP BY 1),
d AS (SELECT user_id, value, median, abs(value - median) AS dev FROM events JOIN m USING (user_id) WHERE event_type = 'purchase'),
a AS (SELECT user_id, coalesce(nullif(median(dev), 0), 1.0::DOUBLE) AS mad FROM d GROUP BY 1),
spikes AS (SELECT user_id, any_value(median) AS median, any_value(mad) AS mad, count(*) FILTER (value > median + (3.0::DOUBLE * 1.4826::DOUBLE) * mad) AS n_spikes,
  coalesce((sum((value - median)::DECIMAL(18,6)) FILTER (value > median + (3.0::DOUBLE * 1.4826::DOUBLE) * mad))::DOUBLE, 0) AS excess FROM d JOIN a USING (user_id) GROUP BY 1)"""


@query(f"WITH {SPIKES} SELECT * FROM spikes")
def mad_spike_trim(spark, sf):
    return metrics.spike_excess(table(spark, sf, "events").filter("event_type = 'purchase'"), "user_id", "value")


@query(f"""WITH {SPIKES}, u AS (SELECT user_id, sum(value::DECIMAL(18,2))::DOUBLE AS raw, CASE WHEN user_id % 4 <> 1 THEN sum(value::DECIMAL(18,2)) FILTER (event_type = 'click')::DOUBLE / nullif(sum(value::DECIMAL(18,2))::DOUBLE, 0) END AS share,
  CASE WHEN user_id % 3 = 0 THEN sum(value::DECIMAL(18,2)) FILTER (event_id % 2 = 0)::DOUBLE END AS prior FROM events GROUP BY 1),
x AS (SELECT u.*, CASE WHEN user_id % 4 = 0 THEN excess END AS spike FROM u LEFT JOIN spikes USING (user_id))
SELECT user_id, CASE WHEN spike IS NOT NULL THEN 'monthly_sync_spike' WHEN share IS NOT NULL THEN 'sync_share_cap' WHEN prior > 0 AND raw / prior - 1 > 0.5 THEN 'geometric_mean_vs_prior' ELSE 'none' END AS method,
  CASE WHEN spike IS NOT NULL THEN 'high' WHEN share IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence,
  round(CASE WHEN spike IS NOT NULL THEN raw - spike WHEN share IS NOT NULL THEN raw - raw * greatest(share - 0.1::DOUBLE, 0) WHEN prior > 0 AND raw / prior - 1 > 0.5 THEN sqrt(raw * prior) ELSE raw END, 6) AS normalized FROM x""")
def normalise_cascade(spark, sf):
    e = table(spark, sf, "events")
    total = fn.money_sum(c("value"))
    part = lambda when: fn.money_sum(F.when(when, c("value")))
    u = e.groupBy("user_id").agg(total.alias("raw"), part(c("event_type") == "click").alias("clicks"), part(c("event_id") % 2 == 0).alias("even"))
    u = u.withColumns({"share": F.when(c("user_id") % 4 != 1, fn.ratio(c("clicks"), c("raw"))), "prior": F.when(c("user_id") % 3 == 0, c("even"))})
    u = u.join(mad_spike_trim(spark, sf).select("user_id", "excess"), "user_id", "left").withColumn("spike", F.when(c("user_id") % 4 == 0, c("excess"))).drop("excess")
    return metrics.normalise(u, "raw", "spike", "raw", "share", "prior").select("user_id", "method", "confidence", F.round("normalized", 6).alias("normalized"))


def order_totals(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    panel = metrics.panel_totals(lines.withColumn("at", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")), "l_orderkey", "at", "l_extendedprice", F.size(F.collect_set("l_suppkey")).alias("n_buyers"))
    o = table(spark, sf, "orders").select(c("o_orderkey").alias("l_orderkey"), c("o_totalprice").alias("lifetime"), (c("o_orderkey") % 8).alias("count"))
    return o.join(panel, "l_orderkey", "left")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem),
t AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS panel, (sum(l_extendedprice::DECIMAL(18,2)) FILTER (rn <= 4))::DOUBLE AS last4, count(DISTINCT l_suppkey) AS buyers FROM r GROUP BY 1)
SELECT o_orderkey AS l_orderkey, coalesce(n, 0) = 0 AS nothing, coalesce(n > 0 AND abs(panel - o_totalprice) > 0.02::DOUBLE * greatest(abs(o_totalprice), 1), false) AS bad_total,
  coalesce(n >= 4 AND abs(last4 - o_totalprice) > 0.02::DOUBLE * greatest(abs(o_totalprice), 1), false) AS bad_last4,
  coalesce(n > 0 AND n <> o_orderkey % 8, false) AS bad_offers, coalesce(n > 0 AND buyers <> o_orderkey % 8, false) AS bad_buyers FROM orders LEFT JOIN t ON l_orderkey = o_orderkey""")
def reconcile(spark, sf):
    found = metrics.reconcile(order_totals(spark, sf), lifetime="lifetime", ltm="lifetime", panel="panel_total", last4="last4_total", n_periods="n_periods", offers="count", n_offers="n_periods", buyers="count", n_buyers="n_buyers")
    some = c("n_periods") > 0
    has = lambda text: F.coalesce(some & F.exists("problems", lambda p: p.contains(text)), F.lit(False))
    return found.select("l_orderkey", F.array_contains("problems", "no periods").alias("nothing"), has("periods sum").alias("bad_total"), has("last four").alias("bad_last4"), has("offers listed").alias("bad_offers"), has("distinct buyers").alias("bad_buyers"))


@query("""SELECT o_custkey, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 4 GROUP BY 1""")
def last_four(spark, sf):
    return ladder.last_n(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 4).groupBy("o_custkey").agg(F.count("*").alias("n"), fn.money_sum(c("o_totalprice")).alias("total"))


@query("""SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_suppliers, count(*) AS n FROM lineitem GROUP BY 1""")
def distinct_count_check(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n_suppliers"), F.count("*").alias("n"))


# -- scalars and parsing -----------------------------------------------------------------------

TERMS = "CASE p_size % 8 WHEN 0 THEN 'life_of_rights' WHEN 1 THEN 'fixed_return' WHEN 2 THEN p_size || '_year' WHEN 3 THEN 'partial_' || p_size || '_year' WHEN 4 THEN p_size || '_yearly' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE p_type END"


@query(f"""SELECT p_partkey, CASE WHEN t = 'life_of_rights' THEN 'perpetual' WHEN t = 'fixed_return' THEN 'fixed_return' WHEN regexp_matches(t, '\\d+_year$') THEN 'fixed_term' ELSE 'unknown' END AS family,
  try_cast(nullif(regexp_extract(t, '(\\d+)_year', 1), '') AS DOUBLE) AS years, starts_with(t, 'partial_') AS partial FROM (SELECT p_partkey, {TERMS} AS t FROM part)""")
def term_taxonomy(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.expr(TERMS).alias("t"))
    return t.select("p_partkey", fn.term_family(c("t")).alias("family"), fn.term_years(c("t")).alias("years"), fn.is_partial_share(c("t")).alias("partial"))


TEXTS = "CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN 'true' WHEN 3 THEN '1d' WHEN 4 THEN '1_000' WHEN 5 THEN NULL WHEN 6 THEN '-' || event_id || '.75' WHEN 7 THEN ' ' || event_id || 'e-1 ' ELSE event_id || '.5' END"


@query(f"""SELECT event_id, x AS number, trunc(x)::BIGINT AS whole FROM (SELECT event_id, CASE WHEN regexp_full_match(trim(t), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim(t) AS DOUBLE) END AS x FROM (SELECT event_id, {TEXTS} AS t FROM events))""")
def lenient_coercion(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(TEXTS).alias("t"))
    return e.select("event_id", fn.to_number(c("t")).alias("number"), fn.to_integer(c("t")).alias("whole"))


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) END AS micros, CASE WHEN event_id % 5 <> 0 THEN ts::DATE::VARCHAR END AS day FROM events""")
def timestamp_parse(spark, sf):
    text = F.when(c("event_id") % 5 == 0, F.lit("2024-13-45")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    e = table(spark, sf, "events").select("event_id", text.alias("t"))
    return e.select("event_id", F.unix_micros(fn.to_timestamp(c("t"))).alias("micros"), fn.to_day(c("t")).cast("string").alias("day"))


@query("""SELECT o_orderkey, datediff('day', o_orderdate::DATE, DATE '2000-01-01') / 365.25::DOUBLE AS age, datediff('day', o_orderdate::DATE, DATE '2000-01-01') / 365.25::DOUBLE + 0.51 < o_orderkey % 10 AS exceeds FROM orders""")
def catalog_age(spark, sf):
    age = fn.years_between(day("o_orderdate"), F.lit("2000-01-01").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", age.alias("age"), (age + F.lit(0.51) < c("o_orderkey") % 10).alias("exceeds"))


@query("""SELECT event_id, 'k' AS key, json_extract_string(props, '$.k')::DOUBLE AS amount FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_unpivot(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return e.select("event_id", "key", fn.to_number(c("v")).alias("amount"))


def index_payloads(spark, sf) -> DataFrame:
    """Orders as index pages of JSON, at most 60 a page: numbers as texts, some ids missing, an unknown nested key, arrays of anything."""
    o = table(spark, sf, "orders")
    row = F.struct(
        F.when(c("o_orderkey") % 10 != 0, c("o_orderkey")).alias("listing_id"), c("o_orderpriority").alias("title"), c("o_totalprice").cast("string").alias("ltm"), (c("o_custkey")).alias("seller_id"), (c("o_orderkey") % 2 == 0).alias("is_nft"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("deal_date"), F.when(c("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"), F.struct(c("o_orderstatus").alias("s")).alias("novel"),
    )
    page = o.groupBy(F.expr("o_orderkey div 60").alias("page")).agg(F.sort_array(F.collect_list(row)).alias("results"))
    return page.select("page", F.to_json(F.struct("results", F.lit("next").alias("next"), F.lit(7).alias("count"))).alias("payload"), F.lit("2024-01-01").cast("timestamp").alias("observed_at"))


@query("""SELECT o_orderkey AS listing_id, o_orderpriority AS title, o_totalprice AS ltm, o_custkey AS seller_id, o_orderkey % 2 = 0 AS is_nft, o_orderdate::DATE::VARCHAR AS deal_day,
  CASE WHEN o_orderkey % 3 = 0 THEN '["a","b"]' ELSE '[]' END AS tags, '{"novel":{"s":"' || o_orderstatus || '"}}' AS raw_extra FROM orders WHERE o_orderkey % 10 <> 0""")
def index_parse(spark, sf):
    found = payloads.index_observations(index_payloads(spark, sf))
    return found.select("listing_id", "title", "ltm", "seller_id", "is_nft", day("deal_date").cast("string").alias("deal_day"), "tags", "raw_extra")


@query("""SELECT o_orderkey // 60 AS page, count(*) FILTER (o_orderkey % 10 <> 0) AS n, 7::BIGINT AS count, 'next' AS next_url FROM orders GROUP BY 1""")
def metadata_default(spark, sf):
    pages = index_payloads(spark, sf)
    ids = payloads.index_listing_ids(pages).groupBy(F.expr("listing_id div 60").alias("page")).agg(F.count("*").alias("n"))
    named = payloads.index_pages(pages).select("page", "count", "next_url").join(ids, "page", "left")
    return named.withColumn("n", F.coalesce("n", F.lit(0)))


WALK = """o AS (SELECT DISTINCT o_orderkey // 60 AS page FROM orders),
p AS (SELECT page, CASE WHEN page % 40 = 39 THEN NULL WHEN page // 40 % 5 = 3 AND page % 40 = 30 THEN page - 25 ELSE page + 1 END AS next FROM o WHERE page // 40 % 5 <> 1 OR page % 40 <> 17)"""


@query(f"""WITH RECURSIVE {WALK},
w AS (SELECT page, page AS spot, 0::BIGINT AS steps FROM p UNION ALL SELECT w.page, p.next, steps + 1 FROM w JOIN p ON p.page = w.spot JOIN p n ON n.page = p.next WHERE steps < 100),
e AS (SELECT page, max(steps) AS steps, arg_max(spot, steps) AS spot FROM w GROUP BY 1),
r AS (SELECT e.page, CASE WHEN steps = 100 THEN 'cycles' WHEN p.next IS NULL THEN 'ends' ELSE 'breaks' END AS status, CASE WHEN steps < 100 THEN e.spot END AS last, CASE WHEN steps < 100 THEN steps END AS steps FROM e JOIN p ON p.page = e.spot)
SELECT page, status, last, steps, CASE WHEN last IS NOT NULL THEN max(steps) OVER (PARTITION BY last) - steps END AS position FROM r""")
def cursor_chain(spark, sf):
    """Pages of orders whose cursors lead on: walks of 40 pages, of which some lack a page and some turn back."""
    group, place = F.expr("page div 40 % 5"), c("page") % 40
    pages = table(spark, sf, "orders").select(F.expr("o_orderkey div 60").alias("page"), "o_orderkey").groupBy("page").agg(F.sort_array(F.collect_list(F.struct(c("o_orderkey").alias("listing_id")))).alias("results"))
    ahead = F.when(place == 39, None).when((group == 3) & (place == 30), c("page") - 25).otherwise(c("page") + 1).cast("string")
    pages = pages.filter((group != 1) | (place != 17))
    payload = F.to_json(F.struct("results", ahead.alias("next")))
    landed = pages.select(c("page").cast("string").alias("url"), payload.alias("payload"), F.lit("2024-01-01").cast("timestamp").alias("observed_at"))
    # An older look at each page, from before it led on.
    older = landed.select("url", F.lit("{}").alias("payload"), F.lit("2023-01-01").cast("timestamp").alias("observed_at"))
    found = payloads.crawl_order(landed.unionByName(older), scratch(spark))
    return found.select(c("url").cast("long").alias("page"), "status", c("last").cast("long").alias("last"), "steps", "position")


def detail_payloads(spark, sf, *, deals: bool = False) -> DataFrame:
    """Orders with their lines as detail payloads of JSON; with deals, two of three have sold to their
    highest line, and there are assets, income mixes, lifetime totals and counts."""
    lines = table(spark, sf, "lineitem")
    offer = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber")
    per = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(offer)).alias("ls"))
    offers = F.transform("ls", lambda x: F.struct(F.when(x["l_partkey"] % 9 != 0, x["l_partkey"]).alias("id"), x["l_suppkey"].alias("buyer_id"), x["l_extendedprice"].cast("string").alias("amount"), F.lit("open").alias("state")))
    quarter = lambda x: F.array(F.concat(F.lit('"2020-0'), (x["l_linenumber"]).cast("string"), F.lit('-01"')), F.to_json(F.struct(x["l_extendedprice"].alias("total"))))
    region = F.concat(F.lit("["), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("["), F.array_join(quarter(x), ","), F.lit("]"))), ","), F.lit("]"))
    mix = F.to_json(F.transform("ls", lambda x: F.struct(F.concat(F.lit("s"), (x["l_suppkey"] % 3).cast("string")).alias("name"), x["l_extendedprice"].alias("earnings"))))
    total = F.aggregate("ls", F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x["l_extendedprice"].cast("decimal(18,2)")).cast("decimal(18,2)"))
    more = F.concat(F.lit(',"top_sources":'), mix, F.lit(',"lifetime_amount":"'), F.when(c("l_orderkey") % 4 == 0, total * 2).otherwise(total).cast("string"), F.lit('"')) if deals else F.lit("")
    if deals:
        aged = '"dollar_age":30,"first_earnings_date":"2020-01-01T00:00:00Z"'
        more = F.concat(more, *[F.when(c("l_orderkey") % n == r, f",{trait}").otherwise("") for n, r, trait in ((4, 1, '"three_years_average":6'), (8, 5, aged))])
    text = F.concat(F.lit('{"id":'), c("l_orderkey").cast("string"), F.lit(',"offers":'), F.to_json(offers), F.lit(',"valuation":{"ltm":"12.5","earnings_by_region":'), region, more, F.lit("}}"))
    best = F.array_max(F.transform("ls", lambda x: F.struct(x["l_extendedprice"].alias("amount"), x["l_partkey"].alias("id"))))
    if deals:
        deal = F.when(c("l_orderkey") % 3 != 0, F.concat(F.lit(',"deal":'), F.to_json(best), F.lit("}"))).otherwise("}")
        asset = F.concat(F.lit(',"asset":{"id":'), (c("l_orderkey") % 500).cast("string"), F.lit('},"offers_received_count":'), F.size("ls").cast("string"))
        traits = [(6, 1, '"term":"fixed_return"'), (5, 2, '"kind":"secondary_listing"'), (7, 3, '"unique_bidder_count":"1"')]
        asset = F.concat(asset, *[F.when(c("l_orderkey") % n == r, f",{trait}").otherwise("") for n, r, trait in traits])
        text = F.concat(F.left(text, F.length(text) - 1), asset, deal)
    return per.select(text.alias("payload"), F.lit("2024-01-01").cast("timestamp").alias("observed_at"))


@query("""SELECT l_orderkey AS listing_id, l_partkey AS offer_id, max(struct_pack(p := l_suppkey, a := l_extendedprice)).p AS buyer_id, max(struct_pack(p := l_suppkey, a := l_extendedprice)).a AS amount
FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY 1, 2""")
def detail_parse_offers(spark, sf):
    return payloads.detail_observations(detail_payloads(spark, sf))["offer"].select("listing_id", "offer_id", "buyer_id", "amount")


@query("""SELECT l_orderkey AS listing_id, make_date(2020, l_linenumber, 1)::VARCHAR AS period_start, arg_max(l_extendedprice, (l_partkey, l_suppkey, l_extendedprice)) AS total FROM lineitem GROUP BY 1, 2""")
def detail_parse_quarters(spark, sf):
    return payloads.detail_observations(detail_payloads(spark, sf))["quarter"].select("listing_id", iso("period_start"), "total")


REBUILT = """WITH o AS (SELECT l_orderkey AS k, l_partkey AS p, max(struct_pack(s := l_suppkey, a := l_extendedprice)).a AS a FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY 1, 2),
d AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 3 <> 0 THEN max(struct_pack(a := l_extendedprice, p := l_partkey)) END AS d FROM lineitem GROUP BY 1),
l AS (SELECT k, max(a) FILTER (p <> d.p) AS second_price, min(a) AS opening_price FROM o JOIN d USING (k) GROUP BY 1),
i AS (SELECT o_orderkey AS k, o_totalprice AS ltm, o_orderpriority AS title, o_orderdate::DATE AS deal_date FROM orders WHERE o_orderkey % 10 <> 0),
dim AS (SELECT coalesce(i.k, d.k) AS k, d.k % 500 AS asset, title, deal_date, CASE WHEN d.k IS NULL THEN ltm ELSE 12.5 END AS ltm, d.k IS NOT NULL AS has_detail, (d.k IS NOT NULL)::BIGINT + (i.k IS NOT NULL)::BIGINT AS n_obs, d.d.a AS price
  FROM i FULL OUTER JOIN d ON i.k = d.k)"""


def rebuilt(spark, sf) -> dict[str, DataFrame]:
    """The star schema rebuilt from observations of JSON payloads made of orders and their lines.

    A query asks for one table, so nothing is written for others to read."""
    obs = payloads.detail_observations(detail_payloads(spark, sf, deals=True))
    return star.rebuild({**obs, "index": payloads.index_observations(index_payloads(spark, sf))}, F.lit("2024-01-01").cast("timestamp"))


@query(f"""{REBUILT} SELECT coalesce(i.k, d.k) AS listing_id, d.d.a AS clearing_price, second_price, opening_price, coalesce(d.d.a > 0, false) AS sold,
  CASE WHEN d.d IS NULL THEN 'unsold' ELSE 'none' END AS censoring_flag, d.d.a / nullif(CASE WHEN d.k IS NULL THEN ltm ELSE 12.5 END, 0) AS multiple_gross
FROM i FULL OUTER JOIN d ON i.k = d.k LEFT JOIN l ON l.k = d.k""")
def rebuild_outcomes(spark, sf):
    return rebuilt(spark, sf)["fact_outcome"].select("listing_id", "clearing_price", "second_price", "opening_price", "sold", "censoring_flag", "multiple_gross")


@query(f"""{REBUILT} SELECT * FROM (
  SELECT i.k AS listing_id, 'no_detail_payload' AS flag FROM i ANTI JOIN d USING (k) UNION ALL SELECT i.k, 'no_earnings_panel' FROM i ANTI JOIN d USING (k)
  UNION ALL SELECT i.k, 'missing_ltm' FROM i ANTI JOIN d USING (k) WHERE ltm <= 0
  UNION ALL SELECT k, unnest(['fixed_return_instrument', 'secondary_listing', 'single_bidder', 'ltm_far_above_3yr', 'dollar_age_exceeds_catalog_age'][x + 1:x + 1]) FROM d JOIN (VALUES (0, 6, 1), (1, 5, 2), (2, 7, 3), (3, 4, 1), (4, 8, 5)) r(x, n, m) ON k % n = m
  UNION ALL SELECT k, 'fee_material_vs_price' FROM d WHERE greatest(500.0::DOUBLE, 0.01::DOUBLE * d.a) > 0.02::DOUBLE * d.a)""")
def rebuild_flags(spark, sf):
    return rebuilt(spark, sf)["data_quality_flag"].select("listing_id", "flag")


@query(f"""{REBUILT} SELECT k AS listing_id, asset AS asset_id, title, deal_date::VARCHAR AS deal_date, ltm, has_detail, n_obs AS n_observations FROM dim""")
def rebuild_listings(spark, sf):
    return rebuilt(spark, sf)["dim_listing"].select("listing_id", "asset_id", "title", iso("deal_date"), "ltm", "has_detail", "n_observations")


@query(f"""{REBUILT}, w AS (SELECT l_orderkey AS k, l_partkey AS p, max(struct_pack(s := l_suppkey, a := l_extendedprice)).s AS s, max(struct_pack(s := l_suppkey, a := l_extendedprice)).a AS a FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY 1, 2)
SELECT k AS listing_id, p AS offer_id, s AS buyer_id, a AS amount, CASE WHEN d.d IS NOT NULL THEN p = d.d.p END AS is_winning, row_number() OVER (PARTITION BY k ORDER BY a, p) AS ladder_rank FROM w JOIN d USING (k)""")
def rebuild_offers(spark, sf):
    return rebuilt(spark, sf)["fact_offer"].select("listing_id", "offer_id", "buyer_id", "amount", "is_winning", "ladder_rank")


@query("""WITH m AS (SELECT l_orderkey AS k, 's' || (l_suppkey % 3) AS member, max_by(l_extendedprice, (l_partkey, l_suppkey, l_extendedprice, l_linenumber)) AS amount FROM lineitem GROUP BY 1, 2)
SELECT k AS listing_id, member, amount, amount / nullif(sum(amount::DECIMAL(18,2)) OVER (PARTITION BY k)::DOUBLE, 0) AS share FROM m""")
def rebuild_source_mix(spark, sf):
    return rebuilt(spark, sf)["fact_source_mix"].select("listing_id", "member", "amount", "share")


@query(f"""{REBUILT} SELECT asset AS asset_id, count(*) AS n_listings, count(*) FILTER (price > 0) AS n_sold_listings, count(*) FILTER (price > 0) > 1 AS has_repeat_sale FROM dim WHERE asset IS NOT NULL GROUP BY 1""")
def rebuild_assets(spark, sf):
    return rebuilt(spark, sf)["dim_asset"].select("asset_id", "n_listings", "n_sold_listings", "has_repeat_sale")


@query(f"""{REBUILT} SELECT k AS listing_id, date_trunc('quarter', deal_date)::DATE::VARCHAR AS deal_quarter, price AS clearing_price, price / nullif(ltm, 0) AS multiple_gross,
  (coalesce(ltm, 0) <= 0)::BIGINT + (has_detail AND k % 6 = 1)::BIGINT AS n_exclude_flags FROM dim""")
def rebuild_pricing(spark, sf):
    frame = rebuilt(spark, sf)["v_pricing_frame"]
    return frame.select("listing_id", c("deal_quarter").cast("date").cast("string").alias("deal_quarter"), "clearing_price", "multiple_gross", "n_exclude_flags")


@query(f"""{REBUILT}, s AS (SELECT * FROM dim WHERE price > 0)
SELECT a.asset AS asset_id, a.k AS first_sale, b.k AS later_sale, datediff('day', a.deal_date, b.deal_date) / 365.25::DOUBLE AS years_held, b.price / nullif(a.price, 0) AS price_ratio
FROM s a JOIN s b ON a.asset = b.asset AND b.deal_date > a.deal_date""")
def rebuild_repeat_sales(spark, sf):
    return rebuilt(spark, sf)["v_repeat_sales"].select("asset_id", "first_sale", "later_sale", "years_held", "price_ratio")


def refreshed(spark, sf) -> dict[str, DataFrame]:
    """The star schema after a full refresh from most payloads, and one of what the others add and change."""
    landed = tables.write_tables({"details": detail_payloads(spark, sf, deals=True), "pages": index_payloads(spark, sf)}, scratch(spark))
    details, pages = landed["details"].withColumn("late", F.get_json_object("payload", "$.id").cast("long") % 9 == 4), landed["pages"].withColumn("late", c("page") % 17 == 3)
    where, keep = scratch(spark), lambda df, name: tables.write_tables({name: df}, scratch(spark))[name]
    store, as_of = incremental.star_store(spark, f"{where}/star", 16), F.lit("2024-01-01").cast("timestamp")
    for late in (False, True):
        obs = payloads.detail_observations(details.filter(c("late") == late))
        made = {name: obs[name] for name in ("listing", "offer", "quarter", "breakdown")} | {"index": payloads.index_observations(pages.filter(c("late") == late))}
        batch = {}
        for name, rows in made.items():
            batch[name] = tables.write_tables({f"late={late}": rows}, f"{where}/observations/{name}")[f"late={late}"]
        if late:
            every = {name: early[name].unionByName(batch[name]) for name in batch}
            incremental.refresh(store, every, incremental.changed_listings(batch), as_of, keep, scratch(spark))
        else:
            early = batch
            incremental.full_refresh(store, batch, as_of, scratch(spark))
    return store.read()


@query(f"""{REBUILT} SELECT coalesce(i.k, d.k) AS listing_id, d.k % 500 AS asset_id, d.d.a AS clearing_price, second_price, coalesce(d.d.a > 0, false) AS sold, (d.k IS NOT NULL)::BIGINT + (i.k IS NOT NULL)::BIGINT AS n_observations
FROM i FULL OUTER JOIN d ON i.k = d.k LEFT JOIN l ON l.k = d.k""")
def refresh_outcomes(spark, sf):
    t = refreshed(spark, sf)
    return t["fact_outcome"].join(t["dim_listing"].select("listing_id", "asset_id", "n_observations"), "listing_id").select("listing_id", "asset_id", "clearing_price", "second_price", "sold", "n_observations")


@query(f"""{REBUILT}, s AS (SELECT * FROM dim WHERE price > 0), p AS (SELECT a.asset AS asset_id, count(*) AS n_pairs FROM s a JOIN s b ON a.asset = b.asset AND b.deal_date > a.deal_date GROUP BY 1)
SELECT asset AS asset_id, count(*) AS n_listings, count(*) FILTER (price > 0) AS n_sold_listings, any_value(coalesce(n_pairs, 0)) AS n_pairs FROM dim LEFT JOIN p ON asset_id = asset WHERE asset IS NOT NULL GROUP BY 1""")
def refresh_assets(spark, sf):
    t = refreshed(spark, sf)
    pairs = star.repeat_counts(t["dim_asset"], t["v_pricing_frame"])
    return t["dim_asset"].join(pairs, "asset_id", "left").select("asset_id", "n_listings", "n_sold_listings", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


@query("""WITH o AS (SELECT l_orderkey AS k, l_partkey AS p, count(*) AS c, max(struct_pack(s := l_suppkey, a := l_extendedprice)).s AS s FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY 1, 2),
b AS (SELECT k, count(*) AS n_offers FROM o GROUP BY 1),
q AS (SELECT l_orderkey AS k, l_linenumber AS m, arg_max(l_extendedprice, (l_partkey, l_suppkey, l_extendedprice)) AS t FROM lineitem GROUP BY 1, 2),
p AS (SELECT k, count(*) AS n, sum(t::DECIMAL(18,2))::DOUBLE AS total, (sum(t::DECIMAL(18,2)) FILTER (rn <= 4))::DOUBLE AS last4 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m DESC) AS rn FROM q) GROUP BY 1),
x AS (SELECT l_orderkey AS k, count(*) AS n_lines, (sum(l_extendedprice::DECIMAL(18,2)) * CASE WHEN l_orderkey % 4 = 0 THEN 2 ELSE 1 END)::DOUBLE AS lifetime FROM lineitem GROUP BY 1)
SELECT k AS listing_id, lifetime <> 0 AND abs(total - lifetime) > 0.02::DOUBLE * greatest(abs(lifetime), 1) AS bad_total, n >= 4 AND abs(last4 - 12.5) > 0.02::DOUBLE * 12.5 AS bad_last4, coalesce(n_offers, 0) <> n_lines AS bad_offers
FROM x JOIN p USING (k) LEFT JOIN b USING (k)""")
def reconcile_payloads(spark, sf):
    obs = payloads.detail_observations(detail_payloads(spark, sf, deals=True), folder=scratch(spark))
    found = metrics.reconcile_observations(obs["listing"], obs["offer"], obs["quarter"])
    has = lambda text: F.exists("problems", lambda p: p.contains(text))
    return found.select("listing_id", has("periods sum").alias("bad_total"), has("last four").alias("bad_last4"), has("offers listed").alias("bad_offers"))


@query("""WITH l AS (SELECT user_id, sum(value::DECIMAL(18,2))::DOUBLE AS raw, CASE WHEN user_id % 3 = 0 THEN sum(value::DECIMAL(18,2)) FILTER (event_id % 2 = 0)::DOUBLE END AS prior FROM events GROUP BY 1),
m AS (SELECT user_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS source_type, value FROM events WHERE user_id % 4 = 0 AND event_id % 7 > 0),
p AS (SELECT user_id, sum(value::DECIMAL(18,2))::DOUBLE AS panel FROM m GROUP BY 1),
s AS (SELECT user_id, value FROM m WHERE source_type = 'purchase'),
a AS (SELECT user_id, median(value) AS median FROM s GROUP BY 1),
d AS (SELECT user_id, median, coalesce(nullif(median(abs(value - median)), 0), 1.0::DOUBLE) AS mad FROM s JOIN a USING (user_id) GROUP BY 1, 2),
k AS (SELECT user_id, coalesce((sum((value - median)::DECIMAL(18,6)) FILTER (value > median + (3.0::DOUBLE * 1.4826::DOUBLE) * mad))::DOUBLE, 0) AS excess, count(*) FILTER (value > median + (3.0::DOUBLE * 1.4826::DOUBLE) * mad) AS n FROM s JOIN d USING (user_id) GROUP BY 1),
x AS (SELECT user_id, CASE WHEN user_id % 8 = 2 THEN 0 ELSE value END AS value, event_type FROM events WHERE user_id % 4 > 1),
y AS (SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 AND sum(value) > 0 THEN coalesce(sum(value::DECIMAL(18,2)) FILTER (event_type = 'purchase'), 0)::DOUBLE / sum(value::DECIMAL(18,2))::DOUBLE END AS share FROM x GROUP BY 1),
r AS (SELECT l.*, panel, excess, n, share FROM l LEFT JOIN p USING (user_id) LEFT JOIN k USING (user_id) LEFT JOIN y USING (user_id))
SELECT user_id, CASE WHEN excess IS NOT NULL THEN 'monthly_sync_spike' WHEN share IS NOT NULL THEN 'sync_share_cap' WHEN prior > 0 AND raw / prior - 1 > 0.5 THEN 'geometric_mean_vs_prior' ELSE 'none' END AS method,
  round(CASE WHEN excess IS NOT NULL THEN panel - excess WHEN share IS NOT NULL THEN raw - raw * greatest(share - 0.1::DOUBLE, 0) WHEN prior > 0 AND raw / prior - 1 > 0.5 THEN sqrt(raw * prior) ELSE raw END, 6) AS normalized,
  CASE WHEN excess IS NOT NULL THEN n || ' spikes' WHEN share > 0.1::DOUBLE THEN 'capped' WHEN share IS NOT NULL THEN 'within' WHEN prior > 0 AND raw / prior - 1 > 0.5 THEN 'growth' ELSE 'too little' END AS detail FROM r""")
def normalise_panels(spark, sf):
    e = table(spark, sf, "events")
    listings = e.groupBy("user_id").agg(fn.money_sum(c("value")).alias("raw"), fn.money_sum(F.when(c("event_id") % 2 == 0, c("value"))).alias("even"))
    listings = listings.select("user_id", "raw", F.when(c("user_id") % 3 == 0, c("even")).alias("prior"))
    monthly = e.filter("user_id % 4 = 0 AND event_id % 7 > 0").select("user_id", F.when(c("event_id") % 5 > 0, c("event_type")).alias("source_type"), c("value").alias("amount"))
    mix = e.filter("user_id % 4 > 1").select("user_id", c("event_type").alias("member"), F.when(c("user_id") % 8 == 2, 0.0).otherwise(c("value")).alias("amount"))
    found = metrics.normalise_panels(listings, monthly, mix, "user_id", raw="raw", prior="prior", one_off="purchase")
    words = F.regexp_extract("detail", r"^\d+ spikes|capped|within|growth|too little", 0)
    return found.select("user_id", "method", F.round("normalized", 6).alias("normalized"), words.alias("detail"))


@query("""SELECT sha256(text) AS content_sha256, any_value(octet_length(encode(text))) AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def landing_twice(spark, sf):
    """Texts of many lines land twice; the second time adds nothing."""
    where = scratch(spark)
    for _ in range(2):
        landing.land(table(spark, sf, "documents"), where, "text")
    return landing.landed(spark, where).select(F.sha2(c("payload").cast("binary"), 256).alias("content_sha256"), "n_bytes")


@query("""SELECT DISTINCT sha256(text) AS content_sha256, sha256(text)[1:2] || '/' || sha256(text)[3:4] AS folder, octet_length(encode(text))::BIGINT AS n_bytes, true AS intact FROM documents WHERE text IS NOT NULL""")
def landing_files(spark, sf):
    """Texts land twice as files that their hashes name; the second time adds none."""
    where = scratch(spark)
    for _ in range(2):
        landing.land_files(table(spark, sf, "documents"), where, "text")
    found = landing.landed_files(spark, where)
    return found.select("content_sha256", "folder", F.octet_length("payload").cast("long").alias("n_bytes"), "intact")


@query("""WITH t AS (SELECT 'listing' AS name, l_orderkey AS k FROM lineitem GROUP BY ALL UNION ALL SELECT 'index', o_orderkey FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT 'offer', l_orderkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 9 <> 0)
UNION ALL SELECT 'quarter', l_orderkey FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
UNION ALL SELECT 'breakdown', l_orderkey FROM (SELECT DISTINCT l_orderkey, l_suppkey % 3 FROM lineitem))
SELECT name, k AS listing_id, count(*) AS n FROM t GROUP BY 1, 2""")
def append_twice(spark, sf):
    """All tables of the payloads are appended twice; the second time adds nothing."""
    where = scratch(spark)
    for _ in range(2):
        obs = payloads.detail_observations(detail_payloads(spark, sf, deals=True), folder=scratch(spark))
        ingest.append_observations({"index": payloads.index_observations(index_payloads(spark, sf)), **obs}, where)
    count = lambda name: spark.read.parquet(f"{where}/{name}").groupBy("listing_id").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    out = count("listing")
    for name in ("index", "offer", "quarter", "breakdown"):
        out = out.unionByName(count(name))
    return out


@query("""SELECT event_id, user_id, value FROM events""")
def streaming_ingest(spark, sf):
    """Runs the stream twice over the same file; the second run adds nothing."""
    where = scratch(spark)
    schema = table(spark, sf, "events").schema
    for _ in range(2):
        ingest.ingest_rows(spark, sf, schema, "events.parquet", f"{where}/table", f"{where}/checkpoint", "event_id", at="ts")
    return spark.read.parquet(f"{where}/table").select("event_id", "user_id", "value")


@query("""SELECT o_custkey, o_orderkey, n_obs, first_obs::DATE::VARCHAR AS first_obs, last_obs::DATE::VARCHAR AS last_obs FROM (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey) AS n_obs, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_obs, max(o_orderdate) OVER (PARTITION BY o_custkey) AS last_obs
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)) WHERE rn = 1""")
def streaming_latest(spark, sf):
    """Orders come in three batches, late ones among them; the stream is run again at the end and finds nothing new."""
    where, orders = scratch(spark), table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    store = latest.latest_store(spark, f"{where}/store", "o_custkey", 8)
    for part in (0, 1, 2, 2):
        fresh = orders.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == part)
        fresh.coalesce(1).write.mode("ignore").parquet(f"{where}/in/batch-{part}")
        latest.stream_latest(latest.file_stream(spark, f"{where}/in/*", orders.schema), store, f"{where}/checkpoint", "o_custkey", "o_orderdate", "o_orderkey")
    return store.read()["latest"].select("o_custkey", "o_orderkey", "n_obs", iso("first_obs"), iso("last_obs"))


@query("""SELECT l_orderkey AS k, l_linenumber::BIGINT AS line, CASE WHEN l_orderkey % 13 = 5 THEN 'distribution_year is not int: MMXX' WHEN l_orderkey % 17 = 3 THEN '31 fields, not 32' WHEN l_orderkey % 19 = 2 THEN '33 fields, not 32' END AS reason,
  CASE WHEN l_orderkey % 13 <> 5 AND l_orderkey % 17 <> 3 AND l_orderkey % 19 <> 2 THEN l_extendedprice END AS amount FROM lineitem""")
def export_quarantine(spark, sf):
    """Lines as an earnings export of which some have a word for a year, a field too few or one too many."""
    k = c("l_orderkey")
    texts = {"track_id": k.cast("string"), "track_title": F.concat(F.lit('"a, '), c("l_linenumber").cast("string"), F.lit('"')), "number_of_plays": c("l_linenumber").cast("string"), "payable_amount": c("l_extendedprice").cast("decimal(18,2)").cast("string")}
    texts["distribution_year"] = F.when(k % 13 == 5, "MMXX").otherwise("2020")
    fields = [texts.get(name, F.lit("")) for name in landing.EXPORT_COLUMNS]
    few = (k % 13 != 5) & (k % 17 == 3)
    many = (k % 13 != 5) & (k % 17 != 3) & (k % 19 == 2)
    line = F.concat(F.concat_ws(",", *fields[:-1]), F.when(few, "").when(many, ",,").otherwise(","))
    # An export of the lines of each 2,000 orders, with a head of its own.
    exports = table(spark, sf, "lineitem").select(F.expr("l_orderkey div 2000").alias("export"), line.alias("line")).groupBy("export").agg(F.array_join(F.collect_list("line"), "\r\n").alias("lines"))
    where = scratch(spark)
    exports.select(F.concat(F.lit(",".join(landing.EXPORT_COLUMNS) + "\r\n"), "lines").alias("value")).write.option("maxRecordsPerFile", 1).text(where)
    good = landing.earnings_export(spark, where).select(c("track_id").cast("long").alias("k"), c("number_of_plays").cast("long").alias("line"), F.lit(None).cast("string").alias("reason"), c("payable_amount").cast("double").alias("amount"))
    bad = landing.rejected_earnings(spark, where).select(F.regexp_extract("line", r'"a, \d+",(\d+)', 1).cast("long").alias("k"), F.regexp_extract("line", r'"a, (\d+)"', 1).cast("long").alias("line"), "reason", F.lit(None).cast("double").alias("amount"))
    return good.unionByName(bad)


# -- nested payloads ---------------------------------------------------------------------------


def nested_payloads(spark, sf) -> DataFrame:
    """Orders as detail payloads with all nested lists; some have a text or a list where an object is due."""
    k = c("o_orderkey").cast("string")
    payors = F.when(c("o_orderkey") % 4 == 0, "null").otherwise(F.format_string('[{"name":"p%d","display_name":"P","kind":"k","more":[1]},{"name":"q%d","kind":null}]', c("o_orderkey") % 5, c("o_orderkey") % 3))
    years = F.format_string('{"top_songs":[{"year":"year_1","S%d":%d,"T":"7.5"},{"year":"none","Z":1},9,{"year":"year_12","S":null}],"top_royalty_payors":[{"year":2,"R":"x"}],"top_sources":{}}', c("o_orderkey") % 3, c("o_orderkey") % 50)
    tracks = F.format_string('[{"id":%s,"parent_id":"","title":"t"},{"id":0},{"id":"0","parent_id":"p%s"},{"id":""},{"title":"none"},{"id":false}]', k, k)
    valuation = F.format_string('{"ltm":"%s","top_earnings_by_year":%s,"track_list":%s}', c("o_totalprice").cast("decimal(18,2)"), years, tracks)
    deal = F.when(c("o_orderkey") % 3 == 0, "[1]").otherwise(F.format_string('{"id":%s,"amount":"%s"}', k, c("o_totalprice").cast("decimal(18,2)")))
    history = F.format_string('[{"created_at":"2023-01-0%dT00:00:00Z","buy_now_price":%d},{"buy_now_price":-1},{"buy_now_price":"12.5"}]', c("o_orderkey") % 9 + 1, c("o_orderkey") % 100)
    text = F.format_string(
        '{"id":%s,"asset":{"id":%d,"royalty_payors":%s},"display_state":%s,"deal":%s,"buy_now_price_history":%s,"valuation":%s}',
        k, c("o_orderkey") % 500, payors, F.when(c("o_orderkey") % 5 == 0, '"open"').otherwise('{"message":"m"}'), deal, history, F.when(c("o_orderkey") % 7 == 0, '"none"').otherwise(valuation),
    )
    return table(spark, sf, "orders").select(text.alias("payload"), F.lit("2024-01-01").cast("timestamp").alias("observed_at"))


def nested(spark, sf, name: str) -> DataFrame:
    return payloads.detail_observations(nested_payloads(spark, sf))[name]


@query("""SELECT o_orderkey AS listing_id, o_orderkey % 500 AS asset_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS ltm, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS deal_amount,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS deal_offer_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'm' END AS display_state_msg FROM orders""")
def nested_paths(spark, sf):
    """Paths into objects; null where something else is on the way."""
    return nested(spark, sf, "listing").select("listing_id", "asset_id", "ltm", "deal_amount", "deal_offer_id", "display_state_msg")


@query("""SELECT o_orderkey AS listing_id, CASE WHEN o_orderkey % 4 = 0 THEN '[]' ELSE '[{"name":"p' || (o_orderkey % 5) || '","display_name":"P","kind":"k"},{"name":"q' || (o_orderkey % 3) || '"}]' END AS royalty_payors FROM orders""")
def nested_payors(spark, sf):
    return nested(spark, sf, "listing").select("listing_id", "royalty_payors")


@query("""SELECT o_orderkey AS listing_id, seq, CASE seq WHEN 0 THEN (o_orderkey % 100)::DOUBLE WHEN 1 THEN -1 ELSE 12.5 END AS buy_now_price, CASE WHEN seq = 0 THEN '2023-01-0' || (o_orderkey % 9 + 1) END AS day FROM orders, (SELECT unnest([0, 1, 2])::BIGINT AS seq)""")
def nested_history(spark, sf):
    return nested(spark, sf, "buy_now").select("listing_id", "seq", "buy_now_price", day("created_at").cast("string").alias("day"))


@query("""SELECT o_orderkey AS listing_id, dimension, year_index, CASE WHEN member = 'S?' THEN 'S' || (o_orderkey % 3) ELSE member END AS member, CASE WHEN member = 'S?' THEN (o_orderkey % 50)::DOUBLE ELSE amount END AS amount
FROM orders, (VALUES ('song', 1::BIGINT, 'S?', NULL::DOUBLE), ('song', 1, 'T', 7.5), ('song', 12, 'S', NULL), ('royalty_payor', 2, 'R', NULL)) v(dimension, year_index, member, amount) WHERE o_orderkey % 7 <> 0""")
def nested_years(spark, sf):
    """Annual income by member: every key of a year but its number."""
    return nested(spark, sf, "year").select("listing_id", "dimension", "year_index", "member", "amount")


@query("""SELECT o_orderkey AS listing_id, CASE i WHEN 0 THEN o_orderkey::VARCHAR ELSE '0' END AS track_id, CASE i WHEN 1 THEN 'p' || o_orderkey END AS parent_track_id, CASE i WHEN 0 THEN 't' END AS title FROM orders, (SELECT unnest([0, 1]) AS i) WHERE o_orderkey % 7 <> 0""")
def nested_tracks(spark, sf):
    return nested(spark, sf, "track").select("listing_id", "track_id", "parent_track_id", "title")


@query("""SELECT 'u/' || o_orderkey AS url, CASE WHEN o_orderkey % 6 = 0 THEN 404 ELSE 200 END AS http_status, (o_orderkey % 2 = 0) AS from_cache, 1::BIGINT AS n_ids FROM orders""")
def manifest_append(spark, sf):
    """Fetches are appended in two batches; each has an id of its own."""
    where = scratch(spark)
    fetches = table(spark, sf, "orders").select(F.concat(F.lit("u/"), c("o_orderkey")).alias("url"), F.when(c("o_orderkey") % 6 == 0, 404).otherwise(200).alias("http_status"), (c("o_orderkey") % 2 == 0).alias("from_cache"), c("o_orderkey").alias("not_in_the_manifest"))
    for even in (True, False):
        landing.append_manifest(fetches.filter(c("from_cache") == even), where)
    found = spark.read.parquet(where)
    return found.groupBy("url", "http_status", "from_cache").agg(F.count_distinct("fetch_id").alias("n_ids"))


@query("""SELECT o_custkey AS asset_id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1""")
def published_views(spark, sf):
    """Tables under names of their own, asked by SQL."""
    star.publish({"sold": table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(c("o_custkey").alias("asset_id"))}, "published_")
    return spark.sql("SELECT asset_id, count(*) AS n FROM published_sold GROUP BY asset_id HAVING count(*) > 1")
