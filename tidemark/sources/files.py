"""Small files of a table's bookkeeping, on whatever file system Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _place(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order; nothing if there is none."""
    fs, where = _place(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _place(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _place(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not be there yet; False if it is. Readers see it whole or not at all."""
    context = spark.sparkContext
    folder, _, name = path.rpartition("/")
    fs, beside = _place(spark, f"{folder}/_{name}-{context._jvm.java.util.UUID.randomUUID()}")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    _, where = _place(spark, path)
    kinds = context._gateway.new_array(getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), context._jsc.hadoopConfiguration()).rename(beside, where, kinds)
    except Exception as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        fs.delete(beside, False)
        return False
    return True
