"""The star schema, rebuilt from observations: a pure function of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.coerce import DAYS_PER_QUARTER, buyer_fee, is_partial_share, quarters_between, ratio, safe_corr, term_family, term_years, years_between
from tidemark.operators.flags import Rule, flag_rows, n_flags
from tidemark.operators.ladder import rank_ladder, summarise_ladder, winning
from tidemark.operators.metrics import share_of_total
from tidemark.operators.observations import latest_observation
from tidemark.operators.quantiles import exact_quantiles
from tidemark.sources.snapshots import Tables
from tidemark.sources.tables import write_tables

c = F.col


def spine(index: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Full outer join of two observations of an entity: key, i and d (structs, null where absent)."""
    i = index.select(key, F.struct(*[index[x] for x in index.columns]).alias("i"))
    d = detail.select(key, F.struct(*[detail[x] for x in detail.columns]).alias("d"))
    return i.join(d, key, "full_outer")


def first_of(name: str) -> Column:
    return F.coalesce(c("d")[name], c("i")[name])


def dim_listing(idx: DataFrame, det: DataFrame, as_of: Column) -> DataFrame:
    """One row for each listing of either kind of latest observation; detail comes first.

    as_of stands in for the day of a sale that hasn't been."""
    s, i, d = spine(idx, det, "listing_id"), c("i"), c("d")
    term, ltm = first_of("term"), first_of("ltm")
    age_end = F.coalesce(i["deal_date"], d["published_date"], as_of)
    return s.select(
        "listing_id", d["asset_id"].alias("asset_id"), first_of("title").alias("title"), i["url"].alias("url"), first_of("state").alias("state"), first_of("kind").alias("kind"), term.alias("term"),
        term_family(term).alias("term_family"), term_years(term).alias("term_years"), is_partial_share(term).alias("is_partial_share"), first_of("seller_id").alias("seller_id"),
        first_of("published_date").alias("published_date"), i["deal_date"].alias("deal_date"), i["close_date"].alias("close_date"), ltm.alias("ltm"), d["three_years_average"].alias("three_years_average"),
        d["lifetime_amount"].alias("lifetime_amount"), first_of("dollar_age").alias("dollar_age"), d["first_earnings_date"].alias("first_earnings_date"),
        F.when(d["first_earnings_date"].isNotNull(), years_between(d["first_earnings_date"], age_end)).alias("catalog_age_years"), d["track_count"].alias("track_count"),
        d["minimum_price"].alias("minimum_price"), ratio(d["minimum_price"], ltm).alias("reserve_multiple"), first_of("marketplace_median_multiplier").alias("marketplace_median_multiplier"),
        i["is_marketplace_median_disabled"].alias("is_marketplace_median_disabled"), (F.coalesce(d["n_obs"], F.lit(0)) + F.coalesce(i["n_obs"], F.lit(0))).alias("n_observations"),
        F.least(F.coalesce(d["first_obs"], i["observed_at"]), i["observed_at"]).alias("first_observed_at"), F.greatest(F.coalesce(d["last_obs"], i["observed_at"]), i["observed_at"]).alias("last_observed_at"),
        d.isNotNull().alias("has_detail"), first_of("tags").alias("tags"),
    )


def fact_offer(det: DataFrame, offers: DataFrame) -> DataFrame:
    """The offers of the latest detail observations, with their place in the ladder."""
    kept = offers.drop("listing_id").join(det.select("obs_id", "listing_id", "deal_offer_id"), "obs_id")
    kept = kept.select(
        "listing_id", "offer_id", "buyer_id", "bidder_index", "amount", "multiple", "created_at", "state",
        winning(c("state"), c("offer_id"), c("deal_offer_id")).alias("is_winning"), (c("state") == "fail_offer_increased").alias("is_proxy_increment"),
    )
    return rank_ladder(kept, "listing_id", "amount", "offer_id")


def outcome(base: DataFrame, ladder: DataFrame | None, key: str, *, all_access: bool = False) -> DataFrame:
    """Prices, fees, multiples and censoring of each entity of base.

    base: key, price, ltm, three_years_average, median_multiplier, minimum_price, n_offers; further columns stay.
    Without a ladder base has second_price too."""
    fee = buyer_fee(c("price"), all_access=all_access)
    gross = ratio(c("price"), c("ltm"))
    left = c("minimum_price").isNotNull() & (F.abs(c("price") - c("minimum_price")) < 1e-6)
    both = (base if ladder is None else base.join(ladder, key, "left")).withColumn("buyer_fee_standard", fee)
    return both.withColumns(
        {
            "sold": c("price").isNotNull() & (c("price") > 0),
            "outcome_reason": F.when(c("price") > 0, "sold").when(F.coalesce(c("n_offers"), F.lit(0)) == 0, "no_offers").otherwise("unknown"),
            "winner_margin_over_second": c("price") - c("second_price"),
            "all_in_cost": c("price") + c("buyer_fee_standard"),
            "multiple_gross": gross,
            "multiple_all_in": ratio(c("price") + c("buyer_fee_standard"), c("ltm")),
            "multiple_normalized": ratio(c("price"), c("three_years_average")),
            "multiple_vs_median": ratio(gross, c("median_multiplier")),
            "censoring_flag": F.when(c("price").isNull(), "unsold").when(left, "left_at_reserve").otherwise("none"),
        }
    )


def _priced(dim: DataFrame, det: DataFrame, idx: DataFrame) -> DataFrame:
    base = dim.select("listing_id", "ltm", "three_years_average", c("marketplace_median_multiplier").alias("median_multiplier"), "minimum_price")
    base = base.join(det.select("listing_id", c("deal_amount").alias("_d"), c("deal_buyer_id").alias("buyer_id"), c("offers_received_count").alias("n_offers"), c("unique_bidder_count").alias("n_unique_bidders")), "listing_id", "left")
    return base.join(idx.select("listing_id", c("deal_amount").alias("_i")), "listing_id", "left").withColumn("price", F.coalesce("_d", "_i")).drop("_d", "_i")


def sales(dim: DataFrame, det: DataFrame, idx: DataFrame, *, all_access: bool = False) -> DataFrame:
    """What of fact_outcome doesn't need the ladder of offers, for tables that read no more of it."""
    found = outcome(_priced(dim, det, idx).withColumn("second_price", F.lit(None).cast("double")), None, "listing_id", all_access=all_access)
    return found.select("listing_id", "sold", c("price").alias("clearing_price"), "n_unique_bidders", "buyer_fee_standard")


def fact_outcome(dim: DataFrame, det: DataFrame, idx: DataFrame, offers: DataFrame, *, all_access: bool = False) -> DataFrame:
    found = outcome(_priced(dim, det, idx), summarise_ladder(offers, "listing_id", "buyer_id", "amount", "is_winning"), "listing_id", all_access=all_access)
    return found.select(
        "listing_id", "sold", "outcome_reason", c("price").alias("clearing_price"), "buyer_id", "n_offers", "n_unique_bidders", "second_price", "winner_margin_over_second", "opening_price", "n_bids_by_winner",
        "buyer_fee_standard", "all_in_cost", "multiple_gross", "multiple_all_in", "multiple_normalized", "multiple_vs_median", c("three_years_average").alias("normalized_ltm"), "censoring_flag",
    )


def earnings_panel(rows: DataFrame, entity: str, period: str, deal_date: str) -> DataFrame:
    """rows with quarter_index since the entity's first period and quarters_before_listing
    (positive after the deal)."""
    first = F.min(period).over(W.partitionBy(entity))
    after = F.datediff(period, deal_date) / F.lit(DAYS_PER_QUARTER)
    return rows.withColumns({"quarter_index": quarters_between(first, c(period)), "quarters_before_listing": after})


def fact_earnings_panel(det: DataFrame, quarters: DataFrame, dim: DataFrame) -> DataFrame:
    kept = quarters.drop("listing_id").join(det.select("obs_id", "listing_id", "asset_id"), "obs_id").join(dim.select("listing_id", "deal_date"), "listing_id")
    return earnings_panel(kept, "listing_id", "period_start", "deal_date").select("listing_id", "asset_id", "period_start", "total", "domestic", "intl", "unreported", "quarter_index", "quarters_before_listing")


def fact_source_mix(det: DataFrame, breakdown: DataFrame) -> DataFrame:
    kept = breakdown.drop("listing_id").join(det.select("obs_id", "listing_id"), "obs_id")
    return share_of_total(kept, ["listing_id", "dimension"], "amount").select("listing_id", "dimension", "member", "amount", "share")


def dim_asset(dim: DataFrame, outcomes: DataFrame) -> DataFrame:
    rows = dim.filter("asset_id IS NOT NULL").join(outcomes.select("listing_id", "sold"), "listing_id", "left")
    return rows.groupBy("asset_id").agg(
        F.min_by("title", "listing_id").alias("title"), F.count("*").alias("n_listings"), F.count_if("sold").alias("n_sold_listings"),
        F.min("published_date").alias("first_published"), F.max("published_date").alias("last_published"), (F.count_if("sold") > 1).alias("has_repeat_sale"),
    )


# The flags, their severities and bounds.
RULES = [
    Rule("missing_ltm", "exclude", "no trailing-year income, or none above zero", "ltm IS NULL OR ltm <= 0"),
    Rule("fixed_return_instrument", "exclude", "a fixed return is no perpetuity", "term_family = 'fixed_return'"),
    Rule("no_detail_payload", "warn", "seen in the index only", "NOT has_detail"),
    Rule("no_earnings_panel", "warn", "no quarterly income", "NOT has_panel"),
    Rule("ltm_far_above_3yr", "info", "trailing year above 1.5 times the three-year average", "three_years_average > 0 AND ltm / nullif(three_years_average, 0D) > 1.5"),
    Rule("dollar_age_exceeds_catalog_age", "warn", "weighted age above the catalogue's age", "dollar_age IS NOT NULL AND catalog_age_years IS NOT NULL AND dollar_age > catalog_age_years + 0.51"),
    Rule("secondary_listing", "info", "sold on by an investor", "kind = 'secondary_listing'"),
    Rule("single_bidder", "warn", "one bidder only", "n_unique_bidders = 1"),
    Rule("fee_material_vs_price", "warn", "fee above two percent of the price", "buyer_fee_standard > 0.02 * clearing_price"),
]


def quality_flags(dim: DataFrame, outcomes: DataFrame, panel: DataFrame, flagged_at: Column | None = None) -> DataFrame:
    seen = panel.select("listing_id").distinct().withColumn("has_panel", F.lit(True))
    rows = dim.join(outcomes.select("listing_id", "n_unique_bidders", "buyer_fee_standard", "clearing_price"), "listing_id", "left").join(seen, "listing_id", "left")
    return flag_rows(rows.withColumn("has_panel", F.coalesce("has_panel", F.lit(False))), "listing_id", RULES, flagged_at)


def pricing_frame(dim: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rules that exclude read columns of dim alone, so they are counted there, not from the table of flags."""
    kept = dim.withColumn("n_exclude_flags", n_flags(RULES, "exclude")).drop("minimum_price", "n_observations", "first_observed_at", "last_observed_at", "tags", "has_detail", "url", "title", "state", "close_date", "lifetime_amount", "first_earnings_date")
    wide = kept.join(outcomes.drop("buyer_id", "normalized_ltm", "opening_price", "n_bids_by_winner", "buyer_fee_standard", "all_in_cost", "outcome_reason"), "listing_id", "left")
    return wide.withColumns({"deal_quarter": F.date_trunc("quarter", "deal_date"), "ltm_vs_3yr": ratio(c("ltm"), c("three_years_average"))})


def field_coverage(frame: DataFrame, date: str, kind: str, sold: str, fields: list[str]) -> DataFrame:
    """By year and kind, in their order: rows, sold rows, and the share of rows that have each field."""
    cover = [F.avg(c(f).isNotNull().cast("double")).alias(f"cov_{f}") for f in fields]
    return frame.groupBy(F.date_trunc("year", date).alias("deal_year"), c(kind).alias("kind")).agg(F.count("*").alias("n"), F.count_if(sold).alias("n_sold"), *cover).orderBy(F.asc_nulls_last("deal_year"), F.asc_nulls_last("kind"))


def coverage(frame: DataFrame) -> DataFrame:
    return field_coverage(frame, "deal_date", "kind", "sold", ["dollar_age", "three_years_average", "n_unique_bidders", "marketplace_median_multiplier"])


def age_check(rows: DataFrame, reported: str, size: str, age: str) -> DataFrame:
    """Whether a reported age can be one: correlations, how often it exceeds the entity's age, median, maximum.

    Runs at once, in a few scans; the median is exact (see exact_quantiles)."""
    used = rows.filter(c(reported).isNotNull() & (c(size) > 0))
    log = F.ln(F.when(c(size) > 0, c(size)))
    sums = [F.count("*"), safe_corr(c(reported), log), safe_corr(c(reported), c(age)), F.count_if(c(reported) > c(age) + 0.51), F.max(c(reported).cast("double"))]
    ((median,),), (n, with_size, with_age, exceeds, most) = exact_quantiles(used, [c(reported)], [0.5], also=sums)
    schema = "n long, corr_with_log_size double, corr_with_age double, n_exceeds_age long, median_reported double, max_reported double"
    return rows.sparkSession.createDataFrame([(n, with_size, with_age, exceeds, median, most)], schema)


#: Sales of an asset that are compared in one task; cuts that a larger asset's bands are chosen from.
BAND_SALES, CUTS = 2000, 1000


def date_bands(sales: DataFrame, asset: str, sale: str, date: str, most: int = BAND_SALES) -> DataFrame:
    """sales with _band and _bands: an asset's sales in order of date, about most to a band; one band if it has no more.

    Sales of one day are ordered by a hash, so even a day with most of an
    asset's sales is cut. Only assets with more sales than most are looked at twice."""
    large = sales.groupBy(asset).agg(F.count("*").alias("_n")).filter(c("_n") > most)
    place = F.unix_date(c(date).cast("date")).cast("long") * F.lit(1 << 31) + F.pmod(F.xxhash64(sale), F.lit(1 << 31))
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = sales.join(large, asset).groupBy(asset).agg(F.percentile_approx(place, shares, 10 * CUTS).alias("_cuts"), F.first("_n").alias("_n"))
    bands = F.least(F.ceil(c("_n") / F.lit(most)).cast("int"), F.lit(CUTS))
    chosen = F.transform(F.sequence(F.lit(1), bands - 1), lambda i: F.element_at("_cuts", F.greatest(F.lit(1), F.least(F.lit(CUTS - 1), (i * CUTS / bands).cast("int")))))
    cuts = cuts.select(asset, chosen.alias("_cuts"), bands.alias("_bands"))
    dealt = sales.join(cuts, asset, "left")
    band = F.coalesce(F.size(F.filter("_cuts", lambda x: x < place)), F.lit(0))
    return dealt.withColumns({"_band": F.when(c("_cuts").isNull(), 0).otherwise(band), "_bands": F.coalesce("_bands", F.lit(1))}).drop("_cuts")


def repeat_pairs(sales: DataFrame, asset: str, sale: str, date: str, price: str, size: str, *more: str, most: int = BAND_SALES) -> DataFrame:
    """All ordered pairs of sales of an asset with a later date: an equi-join with a residual range.
    more: columns of the asset that its pairs have too.

    Each pair of an asset's date bands is compared apart, so no key of the join has
    more than about most sales on a side, however many an asset has. Sales without an asset or date are in no pair."""
    used = date_bands(sales.filter(c(asset).isNotNull() & c(date).isNotNull()), asset, sale, date, most)
    columns = lambda prefix: [c(x).alias(f"{prefix}_{n}") for x, n in ((sale, "sale"), (date, "date"), (price, "price"), (size, "size"))]
    a = used.select(asset, *more, *columns("first"), c("_band").alias("_i"), F.explode(F.sequence(c("_band"), c("_bands") - 1)).alias("_j"))
    b = used.select(asset, *columns("later"), F.explode(F.sequence(F.lit(0), c("_band"))).alias("_i"), c("_band").alias("_j"))
    pairs = a.join(b, [asset, "_i", "_j"]).filter("later_date > first_date").drop("_i", "_j")
    return pairs.withColumns({"years_held": years_between(c("first_date"), c("later_date")), "size_ratio": ratio(c("later_size"), c("first_size")), "price_ratio": ratio(c("later_price"), c("first_price"))})


def repeat_sales(assets: DataFrame, frame: DataFrame) -> DataFrame:
    sold = frame.filter("sold").join(assets.filter("has_repeat_sale").select("asset_id", "n_sold_listings"), "asset_id")
    return repeat_pairs(sold, "asset_id", "listing_id", "deal_date", "clearing_price", "ltm", "n_sold_listings")


def repeat_counts(assets: DataFrame, frame: DataFrame) -> DataFrame:
    """asset_id, n_pairs: how many rows repeat_sales has of each asset that has any, without making them.

    Of all pairs of an asset's sales those of one date are none."""
    sold = frame.filter("sold AND deal_date IS NOT NULL").join(assets.filter("has_repeat_sale").select("asset_id"), "asset_id")
    days = sold.groupBy("asset_id", "deal_date").agg(F.count("*").alias("n"))
    counted = days.groupBy("asset_id").agg(F.sum("n").alias("all"), F.sum(c("n") * c("n")).alias("same"))
    return counted.select("asset_id", F.expr("(all * all - same) div 2").alias("n_pairs")).filter("n_pairs > 0")


#: What the star schema reads of the observations; other columns aren't carried through their shuffles.
OBSERVED = {
    "listing": (
        "obs_id listing_id observed_at asset_id title state kind term seller_id published_date ltm three_years_average lifetime_amount dollar_age first_earnings_date track_count "
        "minimum_price marketplace_median_multiplier tags deal_amount deal_offer_id deal_buyer_id offers_received_count unique_bidder_count"
    ).split(),
    "index": (
        "obs_id listing_id observed_at title url state kind term seller_id published_date deal_date close_date ltm dollar_age marketplace_median_multiplier "
        "is_marketplace_median_disabled tags deal_amount"
    ).split(),
}

#: What is read of them beside dim_listing.
FACTS = {
    "listing": "obs_id listing_id observed_at asset_id deal_amount deal_offer_id deal_buyer_id offers_received_count unique_bidder_count".split(),
    "index": "obs_id listing_id observed_at deal_amount".split(),
}


def rebuild(observations: dict[str, DataFrame], as_of: Column, *, all_access: bool = False, folder: str | None = None, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> Tables:
    """All analytic tables and views from obs_index and the tables of detail_observations.

    A table is made when it is first asked for, with the tables that it is made of and no others.
    With a folder the tables that feed several others (latest observations,
    dim_listing, fact_offer, fact_outcome, fact_earnings_panel, dim_asset, the flags and the frame) are written
    there once and read back, so that writing all outputs computes each of them once; keep, if
    given, does that for the tables of the schema instead. Without either a query of one table has nothing on disk but its shuffles."""
    write = lambda name, df: write_tables({name: df}, folder)[name] if folder else df
    kept = lambda name, df: (keep or write)(name, df)
    stored = bool(folder or keep)
    of = lambda name, columns: latest_observation(observations[name].select(*columns[name]), "listing_id", "observed_at", "obs_id")
    latest = Tables({
        "listing": lambda: write("latest_listing", of("listing", OBSERVED)),
        "index": lambda: write("latest_index", of("index", OBSERVED)),
        "det": lambda: latest["listing"] if folder else of("listing", FACTS),
        "idx": lambda: latest["index"] if folder else of("index", FACTS),
        # Where nothing is stored, an outcome is made anew for each that reads it, and then without what it doesn't read.
        "sales": lambda: t["fact_outcome"] if stored else sales(t["dim_listing"], latest["det"], latest["idx"], all_access=all_access),
        "panel": lambda: t["fact_earnings_panel"] if stored else latest["det"].join(observations["quarter"].select("obs_id"), "obs_id", "left_semi"),
        "frame": lambda: t["v_pricing_frame"] if stored else t["dim_listing"].join(latest["sales"], "listing_id", "left"),
    })
    t = Tables({
        "dim_listing": lambda: kept("dim_listing", dim_listing(latest["index"], latest["listing"], as_of)),
        "fact_offer": lambda: kept("fact_offer", fact_offer(latest["det"], observations["offer"])),
        "fact_outcome": lambda: kept("fact_outcome", fact_outcome(t["dim_listing"], latest["det"], latest["idx"], t["fact_offer"], all_access=all_access)),
        "fact_earnings_panel": lambda: kept("fact_earnings_panel", fact_earnings_panel(latest["det"], observations["quarter"], t["dim_listing"])),
        "fact_source_mix": lambda: (keep or (lambda _, df: df))("fact_source_mix", fact_source_mix(latest["det"], observations["breakdown"])),
        "dim_asset": lambda: kept("dim_asset", dim_asset(t["dim_listing"], latest["sales"])),
        "data_quality_flag": lambda: kept("data_quality_flag", quality_flags(t["dim_listing"], latest["sales"], latest["panel"], as_of)),
        "v_pricing_frame": lambda: kept("v_pricing_frame", pricing_frame(t["dim_listing"], t["fact_outcome"])),
        "v_field_coverage": lambda: coverage(t["v_pricing_frame"]),
        "v_dollar_age_check": lambda: age_check(t["dim_listing"], "dollar_age", "ltm", "catalog_age_years"),
        "v_repeat_sales": lambda: repeat_sales(t["dim_asset"], latest["frame"]),
    })
    return t


def publish(tables: Mapping[str, DataFrame], prefix: str = "") -> None:
    """Makes tables views of the session, under their names, for SQL; views of these names are replaced."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
