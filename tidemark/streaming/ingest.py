"""Incremental ingestion: new payload files become observations, exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The keys of the observations' tables.
KEYS = {
    "index": ["obs_id"], "listing": ["obs_id"], "offer": ["obs_id", "offer_id"], "buy_now": ["obs_id", "seq"], "quarter": ["obs_id", "period_start"],
    "year": ["obs_id", "dimension", "year_index", "member"], "breakdown": ["obs_id", "dimension", "member"], "track": ["obs_id", "track_id"],
}

#: What the binary file source gives.
FILE = "path string, modificationTime timestamp, length long, content binary"

#: The column that partitions tables of observations: the day of observation.
DAY = "observed_on"
#: Partitions of a batch that are named one by one; beyond them all from the first to the last are read.
MOST_PARTITIONS = 1000


def touched(batch: DataFrame, within: str) -> Column:
    """A condition of literals on within that holds for every value in batch.

    Only such a condition prunes partitions whatever the plan: a semi-join with
    the batch does so by chance, an anti-join never."""
    return _touched(batch, within)[0]


def _touched(batch: DataFrame, within: str) -> tuple[Column, list | None]:
    """The condition, and the values if they are few and none of them is null."""
    values = batch.select(within).distinct()
    few = values.limit(MOST_PARTITIONS + 2).agg(F.array_agg(within).alias("v"), F.bool_or(F.col(within).isNull()).alias("none")).first()
    if len(few.v) > MOST_PARTITIONS:
        ends = values.agg(F.min(within), F.max(within), F.bool_or(F.col(within).isNull())).first()
        inside, none = F.col(within).between(ends[0], ends[1]), ends[2]
    else:
        inside, none = F.col(within).isin(few.v) if few.v else F.lit(False), few.none
    return (inside | F.col(within).isNull(), None) if none else (inside, few.v if len(few.v) <= MOST_PARTITIONS else None)


def existing(spark: SparkSession, table: str, columns: Iterable[str], where: Column | None = None) -> DataFrame | None:
    """The columns of the table at path table, of the partitions where a condition holds; None before the first batch."""
    try:
        have = spark.read.parquet(table)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    return (have if where is None else have.filter(where)).select(*columns)


def append_new(batch: DataFrame, table: str, keys: str | Iterable[str], *, within: str | None = None, where: Column | None = None) -> None:
    """Appends the rows of batch whose keys the table at path table doesn't have: a replayed batch adds nothing.

    Rows with a null in a key can't be told from a replay and are left out. Of
    rows that repeat a key one is added. within names a column that partitions
    the table and that a key's rows always share, such as the day of
    observation: then only the batch's partitions are read, however large the
    table has grown. where, if given, is their condition (see touched)."""
    spark, keys = batch.sparkSession, [keys] if isinstance(keys, str) else list(keys)
    fresh = batch.dropna(subset=keys).dropDuplicates(keys)
    if within and where is None:
        where = touched(fresh, within)
    have = existing(spark, table, keys, where)
    if have is not None:
        fresh = fresh.join(have, keys, "left_anti")
    writer = fresh.write.mode("append")
    (writer.partitionBy(within) if within else writer).parquet(table)


def append_observations(tables: dict[str, DataFrame], folder: str, observed_at: str = "observed_at") -> None:
    """Appends the tables of index_observations ("index") and detail_observations, each by its own keys.

    All are partitioned by the day that their observation was made on, which
    children take from their listing (in a batch of one day they have that); the batch's days are found once for all
    tables. Loading the same payloads again adds nothing."""
    dated = {name: tables[name].withColumn(DAY, F.to_date(observed_at)) for name in KEYS if name in tables and observed_at in tables[name].columns}
    days = None
    for rows in dated.values():
        days = rows.select(DAY) if days is None else days.unionByName(rows.select(DAY))
    where, values = _touched(days, DAY) if days is not None else (None, None)
    parents = dated["listing"].select("obs_id", DAY) if "listing" in dated else None
    for name, keys in KEYS.items():
        if name in tables:
            if name in dated:
                rows = dated[name]
            elif parents is not None and values and len(values) == 1:  # no join finds another day
                rows = tables[name].withColumn(DAY, F.lit(values[0]))
            else:
                rows = tables[name].join(parents, "obs_id")
            append_new(rows, f"{folder}/{name}", keys, within=DAY, where=where)


def _dated(rows: DataFrame, at: str | None) -> tuple[DataFrame, str | None]:
    return (rows.withColumn(DAY, F.to_date(at)), DAY) if at and at in rows.columns else (rows, None)


def ingest_files(spark: SparkSession, folder: str, table: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], key: str = "obs_id", files_per_batch: int = 1000, at: str | None = "observed_at") -> None:
    """Reads the files that are new in folder, parses them and appends what is new to table, then stops.

    The stream's checkpoint remembers files, the key makes a replay harmless.
    parse gets path, observed_at (the file's time) and payload. Where its rows
    have the column at, the table is partitioned by its day and a batch reads the
    keys of its own days only."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    rows = stream.select("path", F.col("modificationTime").alias("observed_at"), F.col("content").cast("string").alias("payload"))

    def append(batch: DataFrame, _: int) -> None:
        found, within = _dated(parse(batch), at)
        append_new(found, table, key, within=within)

    rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_rows(spark: SparkSession, source: str, schema: str, pattern: str, table: str, checkpoint: str, key: str, at: str | None = None) -> None:
    """The same for Parquet files: only files whose names match pattern."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)

    def append(batch: DataFrame, _: int) -> None:
        found, within = _dated(batch, at)
        append_new(found, table, key, within=within)

    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
