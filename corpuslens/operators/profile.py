"""Profiling (A1-A7): distributions, group sizes, percentiles, column profile.

Group-level statistics run on the per-group count table, never on raw rows.
Spark's exact ``percentile`` keeps a value -> frequency map, and group sizes
take few distinct values, so the exact form stays small at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_fractions(df: DataFrame, col: str, out: str = "fraction") -> DataFrame:
    """(value, n, fraction) with fraction = n / non-null rows; NULL values excluded."""
    base = df.where(F.col(col).isNotNull())
    total = base.select(F.count(F.lit(1))).scalar()
    return (base.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
                .withColumn(out, F.col("n") / total))


def group_sizes(df: DataFrame, key: str, out: str = "n_posts") -> DataFrame:
    """(key, size) per non-null key (posts per author)."""
    return (df.where(F.col(key).isNotNull())
              .groupBy(key).agg(F.count(F.lit(1)).alias(out)))


def size_stats(sizes: DataFrame, size_col: str = "n_posts", q: float = 0.95) -> DataFrame:
    """One row: groups, min, max, mean, median and the ``q`` percentile (linear)."""
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min(size_col).cast("bigint").alias("min_size"),
        F.max(size_col).cast("bigint").alias("max_size"),
        F.avg(size_col).alias("mean_size"),
        F.percentile(F.col(size_col), F.lit(0.5)).alias("median_size"),
        F.percentile(F.col(size_col), F.lit(q)).alias("pct_size"),
    )


def cap_from_percentile(sizes: DataFrame, size_col: str = "n_posts", q: float = 0.95):
    """``floor(percentile(size, q))`` as a scalar-subquery Column."""
    return sizes.select(F.floor(F.percentile(F.col(size_col), F.lit(q))).cast("bigint")).scalar()


def info(df: DataFrame) -> DataFrame:
    """Schema and non-null profile: (position, column_name, data_type, non_null, rows).

    One aggregation over all columns, unpivoted with ``stack``.
    """
    cols = df.columns
    aggs = [F.count(F.col(f"`{c}`")).alias(f"_nn{i}") for i, c in enumerate(cols)]
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = []
    for i, c in enumerate(cols):
        name = c.replace("'", "''")
        parts.append(f"{i}, '{name}', '{types[c]}', _nn{i}")
    stack = f"stack({len(cols)}, {', '.join(parts)}) AS (position, column_name, data_type, non_null)"
    return agg.selectExpr("_rows AS rows", stack).select(
        F.col("position").cast("bigint"), "column_name", "data_type",
        F.col("non_null").cast("bigint"), F.col("rows").cast("bigint"))
