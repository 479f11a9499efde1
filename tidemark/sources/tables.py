"""Named tables in a folder: appended observations, overwritten analytic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> dict[str, DataFrame]:
    """Writes each table under its name and returns them read back.

    overwrite replaces a table as a whole (a full refresh; a failed job leaves no
    half of it), append adds observations. Void columns become strings."""
    out = {}
    for name, df in tables.items():
        plain = df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"})
        plain.write.mode(mode).parquet(f"{folder}/{name}")
        out[name] = df.sparkSession.read.schema(plain.schema).parquet(f"{folder}/{name}")
    return out
