"""Tables as frames, by format, and the few file sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A table by path; the format from its ending unless given. CSV needs a schema, or infers one if asked to."""
    kind = kind or next((k for k in FORMATS if path.rstrip("/").endswith(f".{k}")), "parquet")
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    schema = options.pop("schema", None)
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}) | options)
    reader = reader.schema(schema) if schema else reader
    return reader.format(kind).load(path)


def dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read(spark, f"{folder}/{name}.parquet", "parquet")


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    df.write.mode(mode).format(kind).save(path)


def write_text(path: str, text: str) -> str:
    """A report file on the driver; its folder is made if it isn't there."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return os.path.abspath(path)
