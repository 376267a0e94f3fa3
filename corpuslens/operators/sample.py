"""Reproducible sampling (R1-R4, W2, A5) and hash splitting.

Every random choice is a hash of (row id, seed), so results do not depend on
partitioning, task retries or executor loss:

* order key: ``md5(id | seed)`` (hex), ties by id;
* cap: keep the first k rows of each group in that order (``topk.top_k``, salted, so a hot
  group is cut down in many tasks);
* down-sample: keep the rows ranked <= k in their group, ranks from the
  skew-safe ``topk.hash_rank`` (a hot group is split into 65,536 hash ranges);
* sampling with replacement: draw slot ``i`` of class ``c`` picks the row at
  position ``h(c | i | seed) mod size`` of the class, an equi-join on
  (class, position). Draw slots are generated in chunks, so even a huge class
  never materialises its draws in one task.

md5 is used so the results can be checked against SQL engines;
``xxhash64`` would be faster and works the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import cap_from_percentile, group_sizes
from .topk import hash_rank, top_k

DEFAULT_SEED = 42
DRAW_CHUNK = 100_000


def order_key(id_col, seed: int = DEFAULT_SEED) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws("|", c.cast("string"), F.lit(str(seed))))


def hash_int(*parts: Column, seed: int = DEFAULT_SEED) -> Column:
    """Non-negative 32-bit integer from md5 of the parts joined by '|'."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def hash_wide(*parts: Column, seed: int = DEFAULT_SEED) -> Column:
    """Non-negative 60-bit integer from md5 of the parts joined by '|': reaches every row of any table."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def cap_per_group(df: DataFrame, key: str, id_col: str, k=None, q: float = 0.95,
                  seed: int = DEFAULT_SEED) -> DataFrame:
    """Keep at most k rows per non-null ``key``; smaller groups stay whole.

    ``k`` defaults to ``floor(percentile(group sizes, q))``.
    """
    base = df.where(F.col(key).isNotNull())
    if k is None:
        k = cap_from_percentile(group_sizes(base, key, "_size"), "_size", q)
    k_col = k if isinstance(k, Column) else F.lit(int(k))
    # k rows of each salted sub-group of a key suffice: only they are ranked together.
    order = [F.col("_h").asc(), F.col(id_col).asc()]
    return top_k(base.withColumn("_h", order_key(id_col, seed)), [key], order, k_col, rank_col="_rank",
                 salt_on=[id_col]).drop("_h", "_rank")


def class_sizes(df: DataFrame, class_col: str) -> DataFrame:
    return group_sizes(df, class_col, "_size")


def _draws(sizes: DataFrame, class_col: str, n_col: str, seed: int) -> DataFrame:
    """(class, draw, _pos): ``n_col`` draws per class, position in [0, _size)."""
    chunks = (sizes.where(F.col(n_col) > 0)
                   .withColumn("_chunk", F.explode(F.sequence(
                       F.lit(0), F.floor((F.col(n_col) - 1) / DRAW_CHUNK).cast("int")))))
    # Spread chunk rows before expanding them, so a big class is drawn by many tasks.
    chunks = chunks.repartition(F.col(class_col), F.col("_chunk"))
    lo = F.col("_chunk") * DRAW_CHUNK
    hi = F.least(lo + DRAW_CHUNK, F.col(n_col)) - 1
    slots = chunks.withColumn("draw", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    pos = F.pmod(hash_wide(F.col(class_col), F.col("draw"), seed=seed), F.col("_size"))
    return slots.select(class_col, "draw", pos.alias("_pos"))


def balance(df: DataFrame, class_col: str, id_col: str, how: str = "down",
            seed: int = DEFAULT_SEED) -> DataFrame:
    """Equalise class sizes.

    * ``down``: every class down-sampled without replacement to the smallest size;
    * ``bootstrap``: the smallest size drawn *with* replacement from each class
      (adds ``draw``; ids may repeat);
    * ``up``: every class keeps all rows and tops up to the largest size with
      draws with replacement (original rows have ``draw`` NULL).
    """
    base = df.where(F.col(class_col).isNotNull())
    sizes = class_sizes(base, class_col)
    ranked = hash_rank(base.withColumn("_h", order_key(id_col, seed)), [class_col], "_h",
                       id_col, rank_col="_rank")
    if how == "down":
        k = sizes.select(F.min("_size")).scalar()
        return ranked.where(F.col("_rank") <= k).drop("_h", "_rank")
    if how == "bootstrap":
        target = sizes.select(F.min("_size")).scalar()
        need = sizes.withColumn("_need", target)
    elif how == "up":
        target = sizes.select(F.max("_size")).scalar()
        need = sizes.withColumn("_need", target - F.col("_size"))
    else:
        raise ValueError(f"unknown balance mode {how!r}")
    draws = _draws(need, class_col, "_need", seed)
    rows = ranked.withColumn("_pos", F.col("_rank") - 1).drop("_h", "_rank")
    drawn = rows.join(draws, [class_col, "_pos"], "inner").drop("_pos")
    if how == "bootstrap":
        return drawn
    kept = rows.drop("_pos").withColumn("draw", F.lit(None).cast("bigint"))
    return kept.unionByName(drawn)


def hash_split(df: DataFrame, id_col: str, train_frac: float = 0.8,
               seed: int = DEFAULT_SEED, out: str = "split") -> DataFrame:
    """Label rows 'train'/'test' by a hash bucket of the id (stable, disjoint)."""
    bucket = F.pmod(hash_int(F.col(id_col), seed=seed), F.lit(10_000))
    return df.withColumn(out, F.when(bucket < int(round(train_frac * 10_000)), F.lit("train"))
                              .otherwise(F.lit("test")))
