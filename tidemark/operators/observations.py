"""Observations: latest per entity, keyed upserts, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpacked(columns: list[str], keys: list[str], row: str = "_row") -> list[Column]:
    """The columns of a struct that an aggregate by keys has made of rows; keys are the groups' own, so
    that Spark knows how the rows lie and a join or an aggregate by them shuffles nothing again."""
    return [F.col(x) if x in keys else F.col(row)[x].alias(x) for x in columns]


def latest_observation(obs: DataFrame, entity: str, observed_at: str, tie: str) -> DataFrame:
    """The last observation of each entity, with n_obs, first_obs and last_obs.

    An aggregate, not a window: it combines before the shuffle, so an entity
    with a third of all observations stays cheap. A null instant comes before
    any other; ties go to the larger tie."""
    row = F.struct(*[obs[c] for c in obs.columns])
    best = F.max_by(row, F.struct(obs[observed_at], obs[tie]))
    found = obs.groupBy(entity).agg(best.alias("_row"), F.count("*").alias("n_obs"), F.min(observed_at).alias("first_obs"), F.max(observed_at).alias("last_obs"))
    return found.select(*unpacked(obs.columns, [entity]), "n_obs", "first_obs", "last_obs")


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the last in order (an upsert into an empty table)."""
    row = F.struct(*[df[c] for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def with_content_hash(df: DataFrame, content: str, name: str = "content_sha256") -> DataFrame:
    return df.withColumn(name, F.sha2(df[content].cast("binary"), 256))


def distinct_payloads(df: DataFrame, content: str, key: str) -> DataFrame:
    """One row for each content: its hash, the smallest key that has it, and how many do."""
    return with_content_hash(df.filter(df[content].isNotNull()), content).groupBy("content_sha256").agg(F.min(key).alias("first_key"), F.count("*").alias("n_copies"))


def observation_id(*columns: str):
    """A stable id for an observation; needs no counter and survives a reload."""
    return F.xxhash64(*columns)
