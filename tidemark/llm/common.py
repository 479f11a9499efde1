"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: Words are maximal runs of bytes other than space and U+0009..U+000D.
SPACES = " \t\n\x0b\f\r"
#: The same class for Spark's regular expressions.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when the application ends."""
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    fs, where = _file_system(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back.

    It cuts the lineage: what follows reads files that survive the loss of
    executors. The files go with discard, or when the application ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/table"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for table in tables:
        fs, where = _file_system(table.sparkSession, table.stored_at)
        fs.delete(where.getParent(), True)


def rows_where(df: DataFrame, condition: Column, columns: list[Column]) -> DataFrame:
    """df.filter(condition).select(columns) for a condition that is costly to compute.

    A plain filter would be pushed down with all its expressions copied into
    it, so that they are computed twice; a generator stays where it is."""
    out = df.select(F.explode_outer(F.when(condition, F.array(F.struct(*columns)))).alias("_row"))
    return out.filter("_row IS NOT NULL").select("_row.*")


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that Python objects for one part stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


