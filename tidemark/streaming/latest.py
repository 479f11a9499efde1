"""The latest observation of each entity, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.operators.observations import latest_observation
from tidemark.sources.snapshots import SnapshotStore


def latest_store(spark: SparkSession, folder: str, entity: str, buckets: int = 64) -> SnapshotStore:
    return SnapshotStore(spark, folder, {"latest": entity}, buckets)


def stream_latest(source: DataFrame, store: SnapshotStore, checkpoint: str, entity: str, observed_at: str, tie: str) -> None:
    """Brings the store's table latest (see latest_observation) up to date with what is new in a streaming source, then stops.

    The aggregate's state holds each entity's best row, count and first and last
    instant, so rows may come in any order and however late: one that is older
    than the latest counts, and changes nothing else. A batch emits the entities that it
    changed; they replace their old rows in the buckets that they lie in. A batch
    that runs again after a failure replaces them by the same rows. Rows without
    an entity are left out. One stream writes to a store at a time."""

    def upsert(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            base = store.current()
            touched = store.touched(batch, entity)
            fresh = batch
            if "latest" in base["tables"]:
                old = store.read(base, {"latest": touched})["latest"]
                fresh = old.join(batch.select(entity), entity, "left_anti").select(*batch.columns).unionByName(batch)
            store.publish({"latest": fresh}, {"latest": touched}, base)
        finally:
            batch.unpersist()

    found = latest_observation(source.filter(source[entity].isNotNull()), entity, observed_at, tie)
    found.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder, so many to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
