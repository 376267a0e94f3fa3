"""User Python functions over columns and partitions (F1, F3), Arrow-batched.

The library's own operators are native column expressions. These two helpers
are the escape hatches for a user's own Python code: a per-value function
(the distributed form of ``Series.apply``, F1) and a per-partition function
(the distributed form of a process pool over row ranges, F3). Both run on
the executors over Arrow batches; nothing passes through the driver and no
group is gathered into one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def map_column(df: DataFrame, col: str, fn: Callable, out: str,
               return_type: DataType | str = "string") -> DataFrame:
    """Add ``out = fn(value)`` for every non-null value of ``col``.

    NULL stays NULL without calling ``fn`` (the type-guarded apply, P6).
    Integer results are carried as a nullable integer series.
    """
    rtype = return_type
    simple = rtype if isinstance(rtype, str) else rtype.simpleString()
    integral = simple in ("int", "bigint", "smallint", "tinyint")

    @F.pandas_udf(rtype)
    def _apply(s: pd.Series, null: pd.Series) -> pd.Series:
        # Arrow hands numeric NULLs over as NaN, so which values are null comes as a column.
        res = pd.Series([None if n else fn(v) for v, n in zip(s, null)], index=s.index, dtype=object)
        return res.astype("Int64") if integral else res

    return df.withColumn(out, _apply(F.col(col), F.col(col).isNull()))


def map_partitions(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame],
                   schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch (a pandas DataFrame) of every partition.

    ``fn`` must map a batch to a batch of ``schema``; batches are independent,
    so the work scales with the partitions and survives task retries.
    """
    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)
