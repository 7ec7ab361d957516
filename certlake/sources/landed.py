"""Readers of landed data. Every schema is given, so no file is read to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from certlake import schemas
from certlake.sources.daystore import DayStore


def read_log_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOG_LIST).json(path, multiLine=True)


def read_tree_heads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TREE_HEADS).json(path)


def read_entry_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one JSON object per line; a `log_url=` folder level prunes by log."""
    return spark.read.schema(schemas.ENTRY_PAGES).json(path)


def stream_entry_pages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same pages as a stream: the stream's checkpoint remembers what was read."""
    reader = spark.readStream.schema(schemas.ENTRY_PAGES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def read_by_day(spark: SparkSession, root: str, columns: str | None = None) -> DataFrame:
    """A stored table of all days; filters on `day` prune whole folders. With `columns` given, no
    file is opened to infer them, and a table without rows can be read too. Tables with manifests are
    read as the newest one says (see `daystore`)."""
    store = DayStore(spark, root)
    if store.exists():
        return store.read(columns)
    reader = spark.read if columns is None else spark.read.schema(f"{columns}, day date")
    return reader.parquet(root)
