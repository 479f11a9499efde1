"""Numeric operators: shares, weighted ages, diagnostics, normalisation, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.coerce import money_sum, ratio, safe_corr
from tidemark.operators.quantiles import exact_quantiles

# Fixed values of the method: scale of the deviation, share cap, lift above which a year is discounted, tolerance.
MAD_SCALE, SPIKE_Z, SHARE_CAP, MAX_LIFT, TOLERANCE, FEWEST_PAIRS = 1.4826, 3.0, 0.10, 0.50, 0.02, 10


def share_of_total(df: DataFrame, keys: list[str], amount: str, name: str = "share") -> DataFrame:
    """df with amount over its total in keys; null for a total of 0."""
    return df.withColumn(name, ratio(F.col(amount), money_sum(F.col(amount), W.partitionBy(*keys))))


def weighted_age(df: DataFrame, keys: list[str], age: str, weight: str) -> DataFrame:
    """keys, weighted_average (null unless the weights sum above 0), weighted_total (null without rows)."""
    used = df.filter(F.col(age).isNotNull() & F.col(weight).isNotNull())
    total, weights = money_sum(F.col(age) * F.col(weight)), money_sum(F.col(weight))
    return used.groupBy(*keys).agg(F.when(weights > 0, total / weights).alias("weighted_average"), total.alias("weighted_total"))


def ratio_diagnostics(df: DataFrame, reported: str, constructions: dict[str, str], size: str) -> DataFrame:
    """For each construction: n, median and interquartile range of reported over it, correlation
    (null below ten pairs); and the correlation of reported with the log of size.

    Runs at once, in a few scans; quantiles are exact (see exact_quantiles)."""
    x = F.col(reported)
    used = {name: x.isNotNull() & F.col(column).isNotNull() for name, column in constructions.items()}
    ratios = [F.when(used[name], ratio(x, F.col(column))) for name, column in constructions.items()]
    log = F.ln(F.greatest(F.col(size), F.lit(1.0)))
    of_size = [F.count_if(x.isNotNull() & F.col(size).isNotNull()), safe_corr(x, F.when(F.col(size).isNotNull(), log))]
    sums = [F.count_if(u) for u in used.values()] + [safe_corr(x, F.col(column)) for column in constructions.values()]
    quartiles, found = exact_quantiles(df, ratios, [0.25, 0.5, 0.75], also=sums + of_size)
    k, rows = len(constructions), []
    for i, name in enumerate(constructions):
        q, enough = quartiles[i], found[i] >= FEWEST_PAIRS
        rows.append((name, found[i], q[1] if enough else None, q[2] - q[0] if enough and q[1] is not None else None, found[k + i] if enough else None))
    rows.append(("size", found[2 * k], None, None, found[2 * k + 1]))
    return df.sparkSession.createDataFrame(rows, "construction string, n long, median_ratio double, iqr_ratio double, corr double")


def spike_excess(df: DataFrame, entity: str, amount: str, z: float = SPIKE_Z) -> DataFrame:
    """entity, median, mad (1 if it is 0), n_spikes and excess: what rows above
    median + z scaled deviations have over the median."""
    med = df.groupBy(entity).agg(F.median(amount).alias("median"))
    dev = df.join(med, entity).withColumn("dev", F.abs(F.col(amount) - F.col("median")))
    mad = dev.groupBy(entity).agg(F.median("dev").alias("mad"))
    both = dev.join(mad.withColumn("mad", F.coalesce(F.nullif("mad", F.lit(0.0)), F.lit(1.0))), entity)
    spike = F.col(amount) > F.col("median") + z * MAD_SCALE * F.col("mad")
    over = F.when(spike, F.col(amount) - F.col("median"))
    return both.groupBy(entity).agg(
        F.first("median").alias("median"), F.first("mad").alias("mad"), F.count_if(spike).alias("n_spikes"), F.coalesce(money_sum(over), F.lit(0.0)).alias("excess")
    )


def normalise(df: DataFrame, raw: str, spike: str, panel_total: str, share: str, prior: str, *, n_spikes: str | None = None, median: str | None = None) -> DataFrame:
    """df with normalized, excess, method, confidence and detail, by the best evidence there is.

    spike: excess of spikes, null without a panel that has such income;
    panel_total: the panel's sum; share: share of such income in the mix, null
    if the mix doesn't say; prior: the total of the year before. n_spikes and
    median, where given, are named in detail."""
    r, s, t, x, p = (F.col(c) for c in (raw, spike, panel_total, share, prior))
    capped = F.greatest(x - SHARE_CAP, F.lit(0.0))
    lifted = (p > 0) & (r / F.nullif(p, F.lit(0.0)) - 1 > MAX_LIFT)
    mean = F.sqrt(r * p)
    cases = [
        (s.isNotNull(), t - s, s, "monthly_sync_spike", "high"),
        (x.isNotNull(), r - r * capped, r * capped, "sync_share_cap", "medium"),
        (lifted, mean, r - mean, "geometric_mean_vs_prior", "low"),
    ]

    def pick(i: int, other: Column) -> Column:
        out = other
        for when, *values in reversed(cases):
            value = values[i] if isinstance(values[i], Column) else F.lit(values[i])
            out = F.when(when, value).otherwise(out)
        return out

    # Halves go to the even neighbour, which the format alone doesn't do.
    percent = lambda x, form="%.0f%%": F.format_string(form, F.rint(x * 100))
    trimmed = F.format_string("%d spikes trimmed to the median of %,.0f", n_spikes, F.rint(median)) if n_spikes and median else F.lit("spikes trimmed to their median")
    cap = F.format_string("%.0f%%", F.lit(SHARE_CAP * 100))
    detail = (
        F.when(s.isNotNull(), trimmed)
        .when(x > SHARE_CAP, F.concat(F.lit("share of "), percent(x), F.lit(" capped at "), cap))
        .when(x.isNotNull(), F.concat(F.lit("share of "), percent(x), F.lit(" is within the cap")))
        .when(lifted, F.concat(percent(r / F.nullif(p, F.lit(0.0)) - 1, "%+.0f%%"), F.lit(" on the year before, by one-off income or growth")))
        .otherwise("too little detail to normalise")
    )
    return df.withColumn("detail", detail).withColumns({"normalized": pick(0, r), "excess": pick(1, F.lit(0.0)), "method": pick(2, F.lit("none")), "confidence": pick(3, F.lit("low"))})


def normalise_panels(listings: DataFrame, monthly: DataFrame, mix: DataFrame, key: str, *, raw: str, prior: str, source: str = "source_type", amount: str = "amount", member: str = "member", one_off: str = "sync", z: float = SPIKE_Z) -> DataFrame:
    """listings (key, raw, prior) normalised from their monthly panels and income mixes.

    monthly: key, source, amount; a null source is no one-off income. mix: key,
    member, amount; it says something if it has one-off income at all and sums
    above 0. All three may lack keys of the others. See normalise for the columns added."""
    spikes = spike_excess(monthly.filter(F.col(source).eqNullSafe(F.lit(one_off))), key, amount, z)
    spikes = spikes.select(key, F.col("median").alias("_median"), "n_spikes", F.col("excess").alias("_spike"))
    panel = monthly.groupBy(key).agg(money_sum(F.col(amount)).alias("_panel"))
    own = F.col(member) == one_off
    parts = mix.groupBy(key).agg(money_sum(F.coalesce(amount, F.lit(0.0))).alias("_all"), money_sum(F.when(own, F.coalesce(amount, F.lit(0.0)))).alias("_own"), F.count_if(own).alias("_has"))
    share = F.when((F.col("_has") > 0) & (F.col("_all") > 0), ratio(F.coalesce("_own", F.lit(0.0)), F.col("_all")))
    both = listings.join(panel, key, "left").join(spikes, key, "left").join(parts, key, "left").withColumn("_share", share)
    found = normalise(both, raw, "_spike", "_panel", "_share", prior, n_spikes="n_spikes", median="_median")
    return found.drop("_panel", "_spike", "_median", "_all", "_own", "_has", "_share", "n_spikes")


def reconcile(totals: DataFrame, *, lifetime: str, ltm: str, panel: str, last4: str, n_periods: str, offers: str, n_offers: str, buyers: str, n_buyers: str, tol: float = TOLERANCE) -> DataFrame:
    """totals with an array of problems: what a listing's parts don't add up to.

    Rules are independent; each needs its own figures to be there. Differences
    count beyond tol of the figure, or of 1 if that is more."""

    def off(a: Column, b: Column) -> Column:
        return b.isNotNull() & (b != 0) & (F.abs(a - b) > tol * F.greatest(F.abs(b), F.lit(1.0)))

    c = F.col
    text = lambda pattern, *cols: F.format_string(pattern, *cols)
    none = c(n_periods).isNull() | (c(n_periods) == 0)
    rules = [
        (off(c(panel), c(lifetime)), text("periods sum to %,.2f, lifetime is %,.2f", c(panel), c(lifetime))),
        ((c(n_periods) >= 4) & off(c(last4), c(ltm)), text("last four periods %,.2f, trailing year %,.2f", c(last4), c(ltm))),
        (c(offers).isNotNull() & (c(n_offers) != c(offers)), text("%d offers listed, count says %d", c(n_offers), c(offers))),
        (c(buyers).isNotNull() & (c(n_offers) > 0) & (c(n_buyers) != c(buyers)), text("%d distinct buyers, count says %d", c(n_buyers), c(buyers))),
    ]
    found = F.filter(F.array(*[F.when(when, message) for when, message in rules]), lambda x: x.isNotNull())
    return totals.withColumn("problems", F.when(none, F.array(F.lit("no periods"))).otherwise(found))


def panel_totals(panel: DataFrame, entity: str, period: str, amount: str, *also: Column) -> DataFrame:
    """entity, n_periods, panel total, and the total of its last four periods; null amounts count as 0.

    also: further aggregates of the entity's rows, from the same scan."""
    rank = F.row_number().over(W.partitionBy(entity).orderBy(F.desc(period)))
    ranked = panel.withColumn("_rn", rank)
    value = F.coalesce(F.col(amount), F.lit(0.0))
    return ranked.groupBy(entity).agg(F.count("*").alias("n_periods"), money_sum(value).alias("panel_total"), money_sum(F.when(F.col("_rn") <= 4, value)).alias("last4_total"), *also)


def observation_totals(listing: DataFrame, offer: DataFrame, quarter: DataFrame) -> DataFrame:
    """What reconcile compares, for every parsed listing: its own figures and those of its offers and quarters."""
    bids = offer.groupBy("obs_id").agg(F.count("*").alias("n_offers"), F.count_distinct("buyer_id").alias("n_buyers"))
    panel = panel_totals(quarter, "obs_id", "period_start", "total")
    own = listing.select("obs_id", "listing_id", "lifetime_amount", "ltm", "offers_received_count", "unique_bidder_count")
    both = own.join(panel, "obs_id", "left").join(bids, "obs_id", "left")
    return both.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_offers", "n_buyers", "n_periods")})


def reconcile_observations(listing: DataFrame, offer: DataFrame, quarter: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """obs_id, listing_id, problems and reconciles (whether there are none) of every parsed listing."""
    found = reconcile(
        observation_totals(listing, offer, quarter), lifetime="lifetime_amount", ltm="ltm", panel="panel_total", last4="last4_total", n_periods="n_periods",
        offers="offers_received_count", n_offers="n_offers", buyers="unique_bidder_count", n_buyers="n_buyers", tol=tol,
    )
    return found.select("obs_id", "listing_id", "problems", (F.size("problems") == 0).alias("reconciles"))
