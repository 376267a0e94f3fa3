"""Types of text columns, inferred from all values.

A column's type is the narrowest of TYPES that every value has: boolean, bigint within double, date within
timestamp, else string. One aggregation counts, for each column and type, the values that have it and keeps the
least value that hasn't; a type is a function of these counts, so it doesn't depend on the order or the split of
the rows. Where a column is text only because of some values, the report names its likely type, how many values
are against it and the least of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From narrow to wide within a branch; a bigint has 18 digits at most.
TYPES = ("boolean", "bigint", "double", "date", "timestamp")
# The shapes of values.
SHAPES = {"boolean": r"^(true|false|True|False|TRUE|FALSE)$",
          "bigint": r"^[+-]?[0-9]{1,18}$",
          "double": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,2})?$",
          "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
          "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?)?$"}


def has_type(c: Column, name: str) -> Column:
    """Whether a value that isn't null has the shape of the type and, for times, stands in the calendar."""
    shaped = c.rlike(SHAPES[name])
    return shaped & c.try_cast(name).isNotNull() if name in ("date", "timestamp") else shaped


def evidence(df: DataFrame) -> DataFrame:
    """A row per column of texts: ``column_name``, ``type``, ``n_values``, ``n_null``, the ``n_`` of each type,
    ``likely`` (the type of most values; ties: the narrower), ``n_against`` it and the least value ``against`` it."""
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for k, name in enumerate(df.columns):
        c = F.col(f"`{name}`").cast("string")
        aggs.append(F.count(c).alias(f"v{k}"))
        for t in TYPES:
            aggs.append(F.count(F.when(has_type(c, t), 1)).alias(f"{t}{k}"))
            aggs.append(F.min(F.when(~has_type(c, t), c)).alias(f"not_{t}{k}"))
    one = df.agg(*aggs)
    for k, name in enumerate(df.columns):
        n = F.col(f"v{k}")
        is_all = [(F.col(f"{t}{k}") == n) & (n > 0) for t in TYPES]
        kind = reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest),
                      reversed(list(zip(is_all, TYPES))), F.lit("string"))
        most = F.greatest(*[F.col(f"{t}{k}") for t in TYPES])
        likely = reduce(lambda rest, t: F.when(F.col(f"{t}{k}") == most, t).otherwise(rest), reversed(TYPES),
                        F.lit(None).cast("string"))
        against = reduce(lambda rest, t: F.when(F.col(f"{t}{k}") == most, F.col(f"not_{t}{k}")).otherwise(rest),
                         reversed(TYPES), F.lit(None).cast("string"))
        some = most > 0
        rows.append(F.struct(
            F.lit(name).alias("column_name"), kind.alias("type"), n.alias("n_values"), (F.col("n") - n).alias("n_null"),
            *[F.col(f"{t}{k}").alias(f"n_{t}") for t in TYPES], F.when(some, likely).alias("likely"),
            F.when(some, n - most).alias("n_against"), F.when(some, against).alias("against")))
    return one.select(F.inline(F.array(*rows)))


def typed(df: DataFrame) -> DataFrame:
    """``df`` with each text column in its inferred type."""
    kinds = {r["column_name"]: r["type"] for r in evidence(df).collect()}  # a row per column
    return df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in df.columns])
