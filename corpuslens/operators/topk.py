"""Skew-safe per-group ranking.

A plain ``row_number().over(partitionBy(g))`` sends every row of a group to one
task; a group holding a third of the table would then sort a third of the
table in a single task. Both helpers here keep per-group work spread out:

* ``top_k`` - exact top-k per group by any order. Stage 1 ranks inside
  (group, salt) sub-groups, as many as the session shuffles to, and keeps k rows each;
  stage 2 ranks the survivors of each group. Used for top-n reports.
* ``top_counts`` - the k rows of the largest counts per group (``max_features``), for any
  k: the count that the k-th row has is read off a histogram of the counts, so rows above it need
  no sorting at all and only the ties at it are ranked.
* ``hash_rank`` - exact rank of every row inside its group when the order key
  is a uniform hex hash (md5). Buckets are ranges of the hash itself, so the
  rank is the row's number inside its (group, bucket) plus the sizes of the
  earlier buckets. Works for any group size and any k (sampling operators).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_k(df: DataFrame, group_cols: list[str], order: list[Column], k,
          rank_col: str = "rank", salt_buckets: int | None = None,
          salt_on: list[str] | None = None) -> DataFrame:
    """Rows ranked 1..k inside each group by ``order`` (which must be total).

    ``k`` may be an int or a Column (e.g. a scalar subquery). ``salt_on`` names
    columns that spread a group's rows over sub-groups (default: all columns of
    ``df`` that are not group columns).
    """
    k_col = k if isinstance(k, Column) else F.lit(int(k))
    salt_buckets = salt_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt_src = salt_on or [c for c in df.columns if c not in group_cols]
    salt = F.pmod(F.xxhash64(*_cols(salt_src)), F.lit(salt_buckets))
    w1 = Window.partitionBy(*_cols(group_cols), F.col("_salt")).orderBy(*order)
    stage1 = (df.withColumn("_salt", salt)
                .withColumn("_r1", F.row_number().over(w1))
                .where(F.col("_r1") <= k_col)
                .drop("_r1", "_salt"))
    w2 = Window.partitionBy(*_cols(group_cols)).orderBy(*order)
    return (stage1.withColumn(rank_col, F.row_number().over(w2).cast("bigint"))
                  .where(F.col(rank_col) <= k_col))


def top_counts(df: DataFrame, group_col: str, count_col: str, tie_col: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the largest counts (ties: ``tie_col`` ascending).

    The histogram has a row per group and distinct count; a running sum over it, largest first,
    gives each group's cut and how many rows of exactly that count are still wanted.
    """
    w = Window.partitionBy(group_col).orderBy(F.desc(count_col)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cut = (df.groupBy(group_col, count_col).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_upto", F.sum("_n").over(w))
             .where(F.col("_upto") - F.col("_n") < k)
             .groupBy(group_col).agg(F.min(F.struct(F.col(count_col).alias("cut"),
                                                    (k - F.col("_upto") + F.col("_n")).alias("want")))
                                     .alias("_cut")))
    # A row per group: the label set (``df``'s groups are classes).
    near = df.join(F.broadcast(cut), group_col).where(F.col(count_col) >= F.col("_cut.cut"))
    tie = F.col(count_col) == F.col("_cut.cut")
    wanted = near.withColumn("_tie", tie).withColumn(
        "_want", F.when(tie, F.col("_cut.want")).otherwise(F.lit(k)))
    return top_k(wanted, [group_col, "_tie"], [F.col(tie_col).asc()], F.col("_want"), rank_col="_rank",
                 salt_on=[tie_col]).drop("_rank", "_tie", "_want", "_cut")


def hash_rank(df: DataFrame, group_cols: list[str], hash_col: str, id_col: str,
              rank_col: str = "rank", bucket_chars: int = 4) -> DataFrame:
    """Add the exact 1-based rank of each row in its group by (hash, id).

    ``hash_col`` must be a lowercase hex string (md5). The first
    ``bucket_chars`` hex digits give 16**bucket_chars range buckets; each
    (group, bucket) is numbered in its own task and offset by the row counts of
    the group's earlier buckets. The offsets table holds only non-empty
    (group, bucket) pairs, so it never exceeds the input; with the default
    65,536 buckets a group of 3e10 rows is numbered ~500k rows per window.
    """
    g = _cols(group_cols)
    bucket = F.conv(F.substring(F.col(hash_col), 1, bucket_chars), 16, 10).cast("int")
    with_b = df.withColumn("_bucket", bucket)
    counts = with_b.groupBy(*g, F.col("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    wcum = (Window.partitionBy(*g).orderBy("_bucket")
            .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*g, "_bucket",
                            F.coalesce(F.sum("_n").over(wcum), F.lit(0)).alias("_offset"))
    w = Window.partitionBy(*g, F.col("_bucket")).orderBy(F.col(hash_col), F.col(id_col))
    numbered = with_b.withColumn("_r", F.row_number().over(w))
    return (numbered.join(offsets, on=[*group_cols, "_bucket"], how="inner")
                    .withColumn(rank_col, (F.col("_offset") + F.col("_r")).cast("bigint"))
                    .drop("_bucket", "_r", "_offset"))
