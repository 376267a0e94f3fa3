"""Join strategies for a big table against a dimension of unknown size.

A side is broadcast only when its measured bytes fit (``fits_broadcast``); otherwise ``salted_join``
salts the key, so a hot one (a trigram or word present in a third of all rows) is spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 128 << 20


def measured_bytes(df: DataFrame) -> int:
    """About the bytes of a table in memory: string lengths and 16 bytes a column, summed where
    the rows are; one number reaches the driver."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif f.dataType.typeName() == "array":
            size = size + 8 * F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0))
    return df.agg(F.sum(size.cast("bigint"))).first()[0] or 0


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """True when ``df`` measures at most ``max_bytes``."""
    return measured_bytes(df) <= max_bytes


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                salt_buckets: int | None = None, salt_from: list[str] | None = None,
                hot: list | None = None) -> DataFrame:
    """Equi-join with the small side replicated ``salt_buckets`` times (default: 32, or fewer if the
    session shuffles to fewer partitions).

    Each big row gets a salt from a hash of ``salt_from`` (default: all its
    columns), so the rows of one hot key land in ``salt_buckets`` partitions.
    ``hot``: the values of a single key that many big rows have, if they are known; the others then keep one copy.
    With them neither side is sent through the driver.
    """
    salt_buckets = salt_buckets or min(32, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = salt_from or big.columns
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salt_buckets))
    salts = F.sequence(F.lit(0), F.lit(salt_buckets - 1))
    if hot is not None:
        is_hot = F.col(keys[0]).isin(hot) if hot else F.lit(False)
        salt, salts = F.when(is_hot, salt).otherwise(F.lit(0)), F.when(is_hot, salts).otherwise(F.array(F.lit(0)))
        small = small.hint("merge")
    salted_big = big.withColumn("_salt", salt)
    salted_small = small.withColumn("_salt", F.explode(salts))
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt")
