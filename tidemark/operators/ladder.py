"""Bid ladders: ranks, winners, second prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_ladder(offers: DataFrame, listing: str, amount: str, *tie: str, name: str = "ladder_rank") -> DataFrame:
    """offers with their rank by amount in the listing, from 1; null amounts last."""
    order = W.partitionBy(listing).orderBy(F.asc_nulls_last(amount), *tie)
    return offers.withColumn(name, F.row_number().over(order).cast("long"))


def winning(state: Column, offer: Column, deal_offer: Column) -> Column:
    """Whether an offer won; null (not false) if its state doesn't say and the deal's offer is unknown."""
    return (state == "awaiting_transfer") | (offer == deal_offer)


def summarise_ladder(offers: DataFrame, listing: str, buyer: str, amount: str, is_winning: str) -> DataFrame:
    """listing, winner, second_price, opening_price, n_bids_by_winner, n_bids.

    Three-valued: an offer whose is_winning is null is neither winner nor loser,
    so it never makes the second price. Without a winner n_bids_by_winner is 0."""
    by_buyer = offers.groupBy(listing, buyer).agg(
        F.count("*").alias("n"),
        F.bool_or(is_winning).alias("won"),
        F.max(F.when(~F.col(is_winning), F.col(amount))).alias("best_lost"),
        F.min(amount).alias("least"),
    )
    won = F.when(F.col("won"), F.col(buyer))
    return by_buyer.groupBy(listing).agg(
        F.min(won).alias("winner"),
        F.max("best_lost").alias("second_price"),
        F.min("least").alias("opening_price"),
        F.coalesce(F.min_by("n", won), F.lit(0)).alias("n_bids_by_winner"),
        F.sum("n").alias("n_bids"),
    )


def last_n(df: DataFrame, entity: str, order: str, tie: str, n: int) -> DataFrame:
    """The n last rows of each entity."""
    rank = F.row_number().over(W.partitionBy(entity).orderBy(F.desc_nulls_last(order), F.desc(tie)))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")
