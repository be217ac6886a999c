"""S1 — table sources: read the captured-page / history tables as DataFrames.

Every reader goes through ``spark.read.parquet`` so Catalyst can prune
columns and push filters into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages (page_id, url, html) from any parquet location."""
    return spark.read.parquet(path)


def read_pages_stream(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """S1 streaming variant: pages arriving as parquet files in a folder."""
    return (spark.readStream.format("parquet").schema(schema)
            .option("maxFilesPerTrigger", max_files).load(path))
