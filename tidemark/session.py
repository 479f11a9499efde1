"""Session factory with the settings that the operators' results rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable with other engines; ANSI makes a forgotten
#: division guard fail instead of returning null.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "tidemark", *, master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC, ANSI and AQE; further settings override.

    Master, memory and shuffle partitions belong to the cluster and are only
    set here when they are given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RESULT_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(app: str = "tidemark-local", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    n = cpus or min(8, os.cpu_count() or 1)
    return build_session(
        app,
        master=f"local[{n}]",
        **{
            "spark.sql.shuffle.partitions": str(n),
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: what spark.checkpoint.dir names.

    Where it is unset a local master gets a temporary folder, one for each
    application; on a cluster that is an error, for no other machine would see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_FOLDERS[context.applicationId]
