"""Quantiles of rows from sketches that are kept by key and merged (A3 at scale).

A sketch is the ``k`` rows of the smallest hash of their id, and how many rows there are: a sample
without replacement that doesn't depend on how the rows are split or merged. Sketches by key and
day can be written as a table, and merged over days, keys or both as often as wanted: the result
equals the sketch of all rows at once, bit by bit.

The value given for the quantile q lies, with probability of at least ``1 - delta``, between the exact
quantiles ``q - rank_error`` and ``q + rank_error``, with ``rank_error`` = sqrt(ln(2 / delta) / 2k)
(Hoeffding's bound, which holds without replacement too). With at most ``k`` rows the sample is
everything: values are exact (linear between neighbours) and the error is 0.

Defined cases: rows with a null or NaN in a key or the value aren't counted; rows that repeat an id and
a value each count; ids should else be unique, as equal ids are drawn together; an empty table has no
sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import DEFAULT_SEED, order_key
from .topk import top_k

#: Rows that a sketch keeps: 2 % of rank at a delta of 1 in 10,000.
K = 12_000


def _sketches(rows: DataFrame, counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows (keys, _h, _id, _v) and their numbers as a sketch per key."""
    least = top_k(rows, keys, [F.col(c).asc() for c in ("_h", "_id", "_v")], k, rank_col="_place",
                  salt_on=["_h", "_v"])
    entry = F.struct(F.col("_h").alias("h"), F.col("_id").alias("id"), F.col("_v").alias("v"))
    # At most k rows of a key are left to be listed.
    return counts.join(least.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("sample")), keys)


def sketch(df: DataFrame, keys: list[str], value: str, id_col: str, k: int = K,
           seed: int = DEFAULT_SEED) -> DataFrame:
    """(keys, n, sample) of the numbers ``value``."""
    if not keys:
        raise ValueError("a sketch needs a key; a constant column will do")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), F.col(id_col).cast("string").alias("_id"))
    rows = rows.dropna(subset=[*keys, "_v"]).withColumn("_h", order_key("_id", seed))
    return _sketches(rows, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, k)


def merge(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """(keys, n, sample) over all sketches of equal ``keys``, which are some of theirs. ``k`` may be
    at most what the sketches were made with. Samples are merged row by row, so no list grows beyond k."""
    rows = sketches.select(*keys, F.explode("sample").alias("_s")).select(
        *keys, F.col("_s.h").alias("_h"), F.col("_s.id").alias("_id"), F.col("_s.v").alias("_v"))
    return _sketches(rows, sketches.groupBy(*keys).agg(F.sum("n").alias("n")), keys, k)


def quantiles(sketches: DataFrame, keys: list[str], qs: list[float], delta: float = 1e-4) -> DataFrame:
    """(keys, n, q, value, rank_error), a row per sketch and quantile."""
    kept = F.size("sample")
    error = F.when(F.col("n") > kept, F.sqrt(F.lit(math.log(2 / delta) / 2) / kept)).otherwise(F.lit(0.0))
    sorted_ = sketches.select(*keys, "n", error.alias("rank_error"),
                              F.array_sort(F.transform("sample", lambda s: s["v"])).alias("_vs"),
                              F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    at = (F.size("_vs") - 1) * F.col("q")
    low = F.floor(at).cast("int")
    below, above = F.get("_vs", low), F.get("_vs", F.least(low + 1, F.size("_vs") - 1))
    return sorted_.select(*keys, "n", "q", (below + (at - low) * (above - below)).alias("value"), "rank_error")
