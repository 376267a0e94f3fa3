"""Structured Streaming form of the cleaning operators.

The cleaners are stateless projections, so the batch operators apply to a
streaming DataFrame unchanged: new post files are cleaned as they land and
appended to a Parquet table. The running class distribution is the one
stateful piece (a streaming aggregation, complete mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean


def read_posts_stream(spark: SparkSession, path: str, schema: T.StructType,
                      max_files_per_trigger: int = 16) -> DataFrame:
    return (spark.readStream.schema(schema)
                 .option("maxFilesPerTrigger", max_files_per_trigger)
                 .parquet(path))


def clean_stream(stream: DataFrame, text_col: str, how: str = "basic", **kw) -> DataFrame:
    """Cleaned text + word/character counts for every arriving row."""
    return clean.clean_table(stream, text_col, how, **kw)


def class_counts_stream(stream: DataFrame, class_col: str) -> DataFrame:
    """Running (class, n) over all rows seen so far (stateful, complete mode)."""
    return (stream.where(F.col(class_col).isNotNull())
                  .groupBy(class_col).agg(F.count(F.lit(1)).alias("n")))


def write_stream(df: DataFrame, out_path: str, checkpoint: str,
                 available_now: bool = True, mode: str = "append", fmt: str = "parquet"):
    """Start the sink. ``checkpoint`` is a path of its own for this query, kept between
    starts: a query started again with it goes on where it stopped."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if fmt == "memory":
        w = w.format("memory").queryName(out_path)
    else:
        w = w.format(fmt).option("path", out_path)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
