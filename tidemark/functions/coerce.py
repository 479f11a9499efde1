"""Lenient coercions and domain scalars as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: What counts as a number in a payload: no suffixes, no words, no underscores.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

#: A full date, alone or with a time of day and a zone.
INSTANT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?([zZ]|[+-]\d{2}(:?\d{2})?)?)?$"

# Fixed values of the domain: terms, fee schedule.
PERPETUAL_TERM, FIXED_RETURN_TERM = "life_of_rights", "fixed_return"
MINIMUM_FEE, FEE_RATE = 500.0, 0.01
DAYS_PER_YEAR, DAYS_PER_QUARTER = 365.25, 91.31


def to_number(text: Column) -> Column:
    """A double from JSON text; null for null, empty, booleans and anything unparsable. 0 stays 0."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def to_integer(text: Column) -> Column:
    """A long from JSON text, truncated towards zero; null beyond the range of a long."""
    number = to_number(text)
    return F.when(F.abs(number) < 9.2e18, number.try_cast("long"))


def to_timestamp(text: Column) -> Column:
    """An instant from ISO-8601 text with a full date (Z or offset or none: UTC); null if malformed.

    Short forms that a cast would fill up with today's date or the year's first day are malformed."""
    return F.when(text.rlike(INSTANT), text.try_cast("timestamp"))


def to_day(text: Column) -> Column:
    """A date from the first ten characters of ISO text."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(text, F.lit(10)).try_cast("date"))


def term_family(term: Column) -> Column:
    """perpetual, fixed_return, fixed_term or unknown (null and empty terms too)."""
    return (
        F.when(term == PERPETUAL_TERM, "perpetual")
        .when(term == FIXED_RETURN_TERM, "fixed_return")
        .when(term.rlike(r"\d+_year$"), "fixed_term")
        .otherwise("unknown")
    )


def term_years(term: Column) -> Column:
    """The years in front of the first "_year", wherever it stands."""
    return F.nullif(F.regexp_extract(term, r"(\d+)_year", 1), F.lit("")).try_cast("double")


def is_partial_share(term: Column) -> Column:
    return term.startswith("partial_")


def buyer_fee(price: Column, *, all_access: bool = False, opened_bidding: Column | None = None, null_price: float | None = None) -> Column:
    """One percent, at least 500; waived for all-access buyers and for whoever opened the
    bidding. A null price gives null_price."""
    fee = F.lit(0.0) if all_access else F.greatest(F.lit(MINIMUM_FEE), price * FEE_RATE)
    if opened_bidding is not None:
        fee = F.when(opened_bidding, 0.0).otherwise(fee)
    return F.when(price.isNull(), F.lit(null_price).cast("double")).otherwise(fee)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero or null denominator."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(DAYS_PER_YEAR)


def quarters_between(start: Column, end: Column) -> Column:
    """Whole calendar months over three, rounded half to even, as a long."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.bround(months / F.lit(3.0), 0).cast("long")


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, null if there are fewer than two pairs or one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def money_sum(amount: Column, over: WindowSpec | None = None) -> Column:
    """A sum of amounts that keeps parts of cents and doesn't depend on the order of rows, as a double.

    Ten digits after the point are summed exactly. Where an amount or the sum has
    18 digits or more before it, or isn't finite, the sum is that of doubles."""
    exact, plain = amount.try_cast("decimal(28,10)"), amount.cast("double")
    of = (lambda x: x.over(over)) if over is not None else lambda x: x
    whole = of(F.count(amount)) == of(F.count(exact))
    return F.coalesce(F.when(whole, of(F.try_sum(exact)).cast("double")), of(F.sum(plain)))
