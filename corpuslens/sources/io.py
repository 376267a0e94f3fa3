"""Scans and sinks.

Parquet is the format between stages; CSV is supported at the edges (``csv``), exact for quoted line
breaks, doubled quotes, empty texts and NULL, and read by many tasks a file.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import POSTS
from . import csv

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the test tables, ``<sf_dir>/<name>.parquet``.

    ``spread=True`` for CPU-heavy text work: see ``spread``.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread_input(df) if spread else df


def spread_input(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cluster's cores when the scan is under-split.

    A file written as one row group scans in one task however large the
    cluster. Per-row text work (regex chains, tokenising) is CPU-bound, so when
    the scan has fewer splits than the default parallelism the rows are spread
    first. On a real corpus the scan already has thousands of splits and this
    adds nothing (no shuffle).
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def read_posts(spark: SparkSession, path: str, fmt: str = "parquet",
               schema=POSTS, renames: dict[str, str] | None = None) -> DataFrame:
    """Read a posts table with a fixed schema (no inference) and repair names.

    ``renames`` maps source column names to ours, e.g. a misspelt author column.
    """
    if fmt == "csv":
        # With a schema, columns go by their places: the file's names may differ from ours.
        df = csv.read(spark, path, schema)
    else:
        df = spark.read.format(fmt).load(path)
    for old, new in (renames or {}).items():
        df = df.withColumnRenamed(old, new)
    return df


def write_posts(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a table; CSV gets header and quote escaping, never an index column."""
    if fmt == "csv":
        csv.write(df, mode, path, partition_by)
        return
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def documents_as_posts(docs: DataFrame, class_col: str = "lang",
                       author_col: str = "source") -> DataFrame:
    """Map the ``documents`` test table onto the posts schema."""
    return docs.select(
        F.col("doc_id"),
        F.col(author_col).alias("author_id"),
        F.col("text").alias("post"),
        F.col(class_col).alias("class"),
    )
