"""Typed observations from JSON payloads, with built-in functions only.

Payloads are parsed as maps of raw JSON texts, and lists of children as structs of
them, so that a number that comes as a string, a boolean where a number is due, or
a key never seen before all have a defined outcome: coercions give null, unknown
keys go to raw_extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.coerce import to_day, to_integer, to_number, to_timestamp
from tidemark.operators.chains import positions, ranked_chains
from tidemark.operators.observations import unpacked
from tidemark.sources.tables import write_tables

#: Version of these rules, stamped on every observation.
PARSER_VERSION = "1"

# The payload's keys by the type they are read as.
INDEX_TEXT = ["title", "url", "state", "kind", "term", "list_price_multiple_source", "marketplace_median_source", "currency"]
INDEX_FLAG = ["is_marketplace_median_disabled", "is_open_auction", "is_nft", "is_featured"]
INDEX_NUMBER = ["term_remaining", "ltm", "dollar_age", "deal_amount", "list_price", "list_price_multiple", "marketplace_median", "marketplace_median_multiplier", "highest_open_offer_amount"]
INDEX_INTEGER = ["seller_id"]
INDEX_TIME = ["term_expiration", "deal_date", "close_date", "published_date", "accepting_final_offers_start_at", "accepting_final_offers_end_at"]

DETAIL_TEXT = {
    "title": "title", "state": "state", "kind": "kind", "term": "term", "display_state_msg": "display_state.message", "vd_prompt_id": "valuation_description.prompt_id",
    "deal_multiple_source": "deal.multiple_source", "deal_state": "deal.state",
}
DETAIL_FLAG = {"is_track_list_hidden": "is_track_list_hidden"}
DETAIL_NUMBER = {
    "term_return_amount": "term_return_amount", "minimum_price": "minimum_price", "default_buy_now_price": "default_buy_now_price", "buy_now_price": "buy_now_price",
    "proxy_increment_amount": "proxy_increment_amount", "marketplace_median": "marketplace_median", "marketplace_median_multiplier": "marketplace_median_multiplier",
    "ltm": "valuation.ltm", "lifetime_amount": "valuation.lifetime_amount", "three_years_average": "valuation.three_years_average", "dollar_age": "valuation.dollar_age",
    "deal_amount": "deal.amount", "deal_multiple": "deal.multiple",
}
DETAIL_INTEGER = {
    "seller_id": "seller_id", "offers_received_count": "offers_received_count", "unique_bidder_count": "unique_bidder_count",
    "accepting_final_offers_initial_offer": "accepting_final_offers_initial_offer", "track_count": "track_count", "valuation_id": "active_listing_valuation_id",
    "asset_id": "asset.id", "distribution_frequency": "valuation.distribution_frequency", "vd_prompt_version": "valuation_description.prompt_version",
    "deal_offer_id": "deal.id", "deal_buyer_id": "deal.buyer_id",
}
DETAIL_TIME = {
    "term_expiration": "term_expiration", "published_date": "published_date", "accepting_final_offers_start_at": "accepting_final_offers_start_at",
    "accepting_final_offers_end_at": "accepting_final_offers_end_at", "asset_sale_date": "asset.sale_date", "first_earnings_date": "valuation.first_earnings_date",
    "statistics_last_updated": "valuation.statistics_last_updated", "deal_created_at": "deal.created_at",
}
NESTED = ["id", "offers", "deal", "buy_now_price_history", "valuation", "valuation_description", "asset", "display_state", "tags", "media_urls"]
YEAR_DIMENSIONS = {"top_songs": "song", "top_income_types": "income_type", "top_sources": "source", "top_music_users": "music_user", "top_royalty_payors": "royalty_payor"}
LTM_DIMENSIONS = {k: v for k, v in YEAR_DIMENSIONS.items() if k != "top_royalty_payors"}

_MAP = "map<string,string>"


def _object(text: Column) -> Column:
    return F.from_json(text, _MAP)


def _list(text: Column) -> Column:
    """The elements of a JSON array as texts; an empty array for anything else."""
    return F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def _structs(text: Column, fields: str) -> Column:
    """The elements of a JSON array as structs of the fields; null for an element that is no object.

    An array of objects alone is parsed at once; only one with another element in it, which
    would be refused as a whole, is taken apart first."""
    rows = F.when(F.trim(text).startswith("["), F.from_json(text, f"array<struct<{fields}>>"))
    apart = F.transform(_list(text), lambda x: F.from_json(F.when(F.trim(x).startswith("{"), x), f"struct<{fields}>"))
    return F.coalesce(rows, apart)


def _texts(*names: str) -> str:
    return ", ".join(f"{n}: string" for n in names)


def _once(value: Column) -> Column:
    """The value, to be selected; a generator, so that conditions on it aren't pushed below it with a copy of it."""
    return F.explode(F.array(value))


def _array_text(text: Column) -> Column:
    """The JSON text of an array, its elements as they are; "[]" for anything else."""
    return F.when(F.trim(text).startswith("["), text).otherwise("[]")


#: Objects that paths lead through, outer ones first; each is parsed once into a column.
OBJECTS = ["deal", "asset", "display_state", "valuation_description", "valuation", "valuation.top_earnings_by_year"]


def _parsed(path: str) -> str:
    return "_" + path.replace(".", "_")


def _with_objects(df: DataFrame) -> DataFrame:
    """df with a map for each of OBJECTS; null where the payload has no object."""
    for path in OBJECTS:
        text = _dig(path)
        df = df.withColumn(_parsed(path), F.when(F.trim(text).startswith("{"), _object(text)))
    return df


def _dig(path: str) -> Column:
    """The text at a dotted path; null if anything on the way isn't an object."""
    outer, _, last = path.rpartition(".")
    return F.col(_parsed(outer) if outer else "m")[last]


def _flag(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


def _remainder(m: Column, known: list[str]) -> Column:
    """The entries of a map whose keys aren't known, as a JSON object; nested values stay what they were."""
    known_keys = F.array(*[F.lit(k) for k in sorted(known)])
    kept = F.map_filter(m, lambda k, v: ~F.array_contains(known_keys, k))
    return F.to_json(F.transform_values(kept, lambda k, v: F.try_parse_json(v)))


def index_pages(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """pages with next_url, count (the page's own if its meta has none) and meta for the payload."""
    page = pages.withColumn("_p", _object(F.col(payload)))
    meta = F.coalesce(_object(F.col("_p")["meta"]), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    others = [x for x in pages.columns if x != payload]
    return page.select(*others, F.col("_p")["next"].alias("next_url"), to_integer(F.coalesce(meta["count"], F.col("_p")["count"])).alias("count"), to_integer(meta["total_results"]).alias("total_results"), meta.alias("meta"))


def frontier(pages: DataFrame, url: str = "url", payload: str = "payload") -> DataFrame:
    """next_url of the landed pages (url, payload) that has not landed itself: what a crawl has to
    fetch next. Pages are followed by their cursors, whatever their numbers; the last page has none."""
    ahead = index_pages(pages, payload).select("next_url").filter("next_url IS NOT NULL").distinct()
    return ahead.join(pages.select(F.col(url).alias("next_url")), "next_url", "left_anti")


def crawl_order(pages: DataFrame, folder: str, url: str = "url", payload: str = "payload", observed_at: str = "observed_at") -> DataFrame:
    """url, position, last, steps and status of every landed page, by following the cursors of all of them.

    position counts pages from the head of the page's walk. A walk whose status is
    "ends" has landed whole, one that "breaks" goes on at what frontier names, and
    one that "cycles" never ends (position is null). A page that landed more than
    once counts as it was observed last. Intermediate tables are written to folder."""
    named = pages.select(F.col(url).alias("url"), F.col(observed_at).alias("_at"), F.col(payload).alias("payload"))
    latest = index_pages(named).groupBy("url").agg(F.max(F.struct("_at", "next_url")).alias("_last"))
    links = latest.select("url", F.col("_last.next_url").alias("next_url"))
    keep = lambda df, name: write_tables({name: df}, folder)[name]
    return positions(ranked_chains(links, "url", "next_url", keep)).withColumnRenamed("url", url)


def index_listing_ids(pages: DataFrame, payload: str = "payload") -> DataFrame:
    found = pages.select(F.explode(_list(_object(F.col(payload))["results"])).alias("r"))
    return found.select(to_integer(_object(F.col("r"))["listing_id"]).alias("listing_id")).filter("listing_id IS NOT NULL")


def index_observations(pages: DataFrame, payload: str = "payload", observed_at: str = "observed_at") -> DataFrame:
    """One row for each listing of each page; rows without an integer id are left out.

    obs_id is a hash of the payload, the listing and the instant: loading what was observed
    once again gives the same ids, the same payload at another time is another observation."""
    rows = pages.select(F.col(observed_at).alias("observed_at"), F.sha2(F.col(payload).cast("binary"), 256).alias("content_sha256"), F.explode(F.transform(_list(_object(F.col(payload))["results"]), _object)).alias("m"))
    m = F.col("m")
    fields = [m[k].alias(k) for k in INDEX_TEXT] + [_flag(m[k]).alias(k) for k in INDEX_FLAG]
    fields += [f(m[k]).alias(k) for f, keys in ((to_number, INDEX_NUMBER), (to_integer, INDEX_INTEGER), (to_timestamp, INDEX_TIME)) for k in keys]
    known = [*INDEX_TEXT, *INDEX_FLAG, *INDEX_NUMBER, *INDEX_INTEGER, *INDEX_TIME, "listing_id", "tags"]
    out = rows.select(
        to_integer(m["listing_id"]).alias("listing_id"), "observed_at", "content_sha256", *fields, _array_text(m["tags"]).alias("tags"), _remainder(m, known).alias("raw_extra"), F.lit(PARSER_VERSION).alias("parser_version")
    )
    return out.filter("listing_id IS NOT NULL").select(F.xxhash64("content_sha256", "listing_id", "observed_at").alias("obs_id"), "*")


def detail_observations(payloads: DataFrame, payload: str = "payload", observed_at: str = "observed_at", *, folder: str | None = None) -> dict[str, DataFrame]:
    """The tables of a listing's detail payload: listing, offer, buy_now, quarter, year, breakdown, track.

    Payloads without an integer id are in "rejected". Of child rows with the same
    key the last in the payload stays. With a folder the payloads' outer objects
    are parsed once into a table there that all of these read; without one each
    table parses the payloads for itself."""
    base = payloads.select(F.col(observed_at).alias("observed_at"), F.sha2(F.col(payload).cast("binary"), 256).alias("content_sha256"), F.col(payload).alias("payload"), _once(_object(F.col(payload))).alias("m"))
    base = base.withColumn("listing_id", to_integer(F.col("m")["id"])).withColumn("obs_id", F.xxhash64("content_sha256", "listing_id", "observed_at"))
    base = _with_objects(base)
    if folder:
        base = write_tables({"parsed": base}, folder)["parsed"]
    good, m = base.filter("listing_id IS NOT NULL"), F.col("m")
    fields = [_dig(p).alias(c) for c, p in DETAIL_TEXT.items()]
    fields += [f(_dig(p)).alias(c) for f, paths in ((_flag, DETAIL_FLAG), (to_number, DETAIL_NUMBER), (to_integer, DETAIL_INTEGER), (to_timestamp, DETAIL_TIME)) for c, p in paths.items()]
    payors = F.transform(_structs(_dig("asset.royalty_payors"), _texts("name", "display_name", "kind")), lambda x: F.struct(*[x[k].alias(k) for k in ("name", "display_name", "kind")]))
    consumed = [*NESTED, *DETAIL_TEXT, *DETAIL_FLAG, *DETAIL_NUMBER, *DETAIL_INTEGER, *DETAIL_TIME]
    listing = good.select(
        "obs_id", "listing_id", "observed_at", "content_sha256", *fields, _array_text(m["tags"]).alias("tags"), _array_text(m["media_urls"]).alias("media_urls"),
        F.to_json(payors).alias("royalty_payors"), _remainder(m, consumed).alias("raw_extra"), F.lit(PARSER_VERSION).alias("parser_version"),
    )

    def children(text: Column, fields: str, *columns: Column) -> DataFrame:
        rows = good.select("obs_id", "listing_id", F.posexplode(_structs(text, fields)).alias("seq", "e"))
        return rows.select("obs_id", "listing_id", F.col("seq").cast("long").alias("seq"), *columns)

    # An id of the number 0, false or an empty container is none; the text "0" is one.
    track, kind = F.try_variant_get(F.col("e")["id"], "$", "string"), F.schema_of_variant(F.col("e")["id"])
    falsy = (kind != "STRING") & ((to_number(track) == 0) | track.isin("false", "[]", "{}"))

    def last(df: DataFrame, *keys: str) -> DataFrame:
        names = [c for c in df.columns if c != "seq"]
        made = df.groupBy("obs_id", *keys).agg(F.max_by(F.struct(*names), "seq").alias("_row"))
        return made.select(*unpacked(names, ["obs_id", *keys]))

    e = F.col("e")
    integers, instants, others = ["buyer_id", "bidder_index", "countered_offer_id", "counteroffer_id"], ["created_at", "expiration"], ["multiple_source", "kind", "state", "term"]
    offers = children(
        m["offers"], _texts("id", *integers, "amount", "multiple", *others, *instants, "incentive_pool_qualifying"), to_integer(e["id"]).alias("offer_id"), *[to_integer(e[k]).alias(k) for k in integers],
        *[to_number(e[k]).alias(k) for k in ("amount", "multiple")], *[e[k].alias(k) for k in others], *[to_timestamp(e[k]).alias(k) for k in instants], _flag(e["incentive_pool_qualifying"]).alias("incentive_pool_qualifying"),
    )
    buy_now = children(m["buy_now_price_history"], _texts("created_at", "buy_now_price"), to_timestamp(e["created_at"]).alias("created_at"), to_number(e["buy_now_price"]).alias("buy_now_price"))
    parts = ("domestic", "intl", "unreported", "total")
    pair = good.select("obs_id", "listing_id", F.posexplode(_list(_dig("valuation.earnings_by_region"))).alias("seq", "_e")).withColumn("p", _list(F.col("_e")))
    pair = pair.filter((F.size("p") == 2) & F.trim(F.col("p")[1]).startswith("{")).withColumn("e", F.from_json(F.col("p")[1], f"struct<{_texts(*parts)}>")).withColumn("period_start", to_day(F.col("p")[0]))
    quarters = pair.filter("period_start IS NOT NULL").select("obs_id", "listing_id", "seq", "period_start", *[to_number(e[k]).alias(k) for k in parts])

    def dimensioned(root: str, dimensions: dict[str, str], elements) -> DataFrame:
        lists = F.array(*[F.struct(F.lit(d).alias("dimension"), elements(_dig(f"{root}.{k}")).alias("rows")) for k, d in dimensions.items()])
        rows = good.select("obs_id", "listing_id", F.explode(lists).alias("d")).select("obs_id", "listing_id", "d.dimension", F.posexplode("d.rows").alias("seq", "e"))
        return rows.filter("e IS NOT NULL")

    members = lambda text: F.transform(_list(text), lambda x: F.when(F.trim(x).startswith("{"), _object(x)))
    years = dimensioned("valuation.top_earnings_by_year", YEAR_DIMENSIONS, members)
    years = years.withColumn("year_index", to_integer(F.replace(e["year"], F.lit("year_"), F.lit("")))).filter("year_index IS NOT NULL")
    years = years.select("obs_id", "listing_id", "dimension", "year_index", "seq", F.explode(F.map_filter("e", lambda k, v: k != "year")).alias("member", "_a")).withColumn("amount", to_number(F.col("_a"))).drop("_a")
    mix = dimensioned("valuation", LTM_DIMENSIONS, lambda text: _structs(text, _texts("name", "earnings", "track_count")))
    mix = mix.select("obs_id", "listing_id", "seq", "dimension", F.coalesce(e["name"], F.lit("None")).alias("member"), to_number(e["earnings"]).alias("amount"), to_integer(e["track_count"]).alias("track_count"))
    tracks = children(_dig("valuation.track_list"), f"id: variant, {_texts('parent_id', 'title')}", track.alias("track_id"), F.nullif(e["parent_id"], F.lit("")).alias("parent_track_id"), e["title"].alias("title"), F.coalesce(falsy, F.lit(False)).alias("falsy"))
    return {
        "listing": listing,
        "offer": last(offers.filter("offer_id IS NOT NULL"), "offer_id"),
        "buy_now": buy_now,
        "quarter": last(quarters, "period_start"),
        "year": last(years, "dimension", "year_index", "member"),
        "breakdown": last(mix, "dimension", "member"),
        "track": last(tracks.filter("track_id IS NOT NULL AND track_id <> '' AND NOT falsy").drop("falsy"), "track_id"),
        "rejected": base.filter("listing_id IS NULL").select("content_sha256", "observed_at", "payload"),
    }
