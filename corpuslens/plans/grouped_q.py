"""Users' group functions through ``operators.grouped`` (F2): the grouped maps of the data preparation
as functions of partial states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouped, sample
from ..sources.io import read_table
from .profile_q import _md5
from .registry import query

SEED = 42
#: Rows that a capped group keeps.
KEEP = 8


def _first(k: int):
    """The k rows of the smallest (hash, id) of a group, as partial, merge and finish."""
    def least(pairs):
        import heapq

        return heapq.nsmallest(k, pairs)

    def partial(frame):
        return least(zip(frame["h"].tolist(), frame["id"].tolist()))

    def merge(a, b):
        return least([*a, *b])

    def finish(key, state):
        return [(i, n) for n, (_, i) in enumerate(state, 1)]

    return partial, merge, finish


def _moments():
    """Count, sum, sum of squares, least and largest of ``v``, nulls left out; whole numbers, so exact."""
    def partial(frame):
        v = [int(x) for x in frame["v"].dropna()]
        return (len(frame), len(v), sum(v), sum(x * x for x in v), min(v, default=None), max(v, default=None))

    def merge(a, b):
        low, high = [x for x in (a[4], b[4]) if x is not None], [x for x in (a[5], b[5]) if x is not None]
        return (*(x + y for x, y in zip(a[:4], b[:4])), min(low, default=None), max(high, default=None))

    def finish(key, state):
        rows, n, total, squares, low, high = state
        # n * squares - total^2 in Python's whole numbers, then one division
        var = (n * squares - total * total) / (n * (n - 1)) if n > 1 else None
        return [(rows, total if n else None, low, high, total / n if n else None, var)]

    return partial, merge, finish


_DESCRIBED = "n_rows long, total long, low long, high long, mean double, variance double"


@query("grouped_cap", sql=f"""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (
             PARTITION BY o_custkey ORDER BY {_md5('o_orderkey')}, o_orderkey) AS place
           FROM orders WHERE o_custkey IS NOT NULL)
SELECT o_custkey, o_orderkey, place FROM r WHERE place <= {KEEP}""")
def grouped_cap(spark, sf_dir):
    """A cap per author (R1) as a user's grouped map."""
    rows = read_table(spark, sf_dir, "orders", spread=True).select(
        "o_custkey", F.col("o_orderkey").alias("id"), sample.order_key("o_orderkey", SEED).alias("h"))
    return grouped.combine_groups(rows, ["o_custkey"], *_first(KEEP), "o_orderkey long, place long")


@query("grouped_cap_classes", sql=f"""
WITH r AS (SELECT lang, doc_id, row_number() OVER (
             PARTITION BY lang ORDER BY {_md5('doc_id')}, doc_id) AS place
           FROM documents WHERE lang IS NOT NULL)
SELECT lang, doc_id, place FROM r WHERE place <= {KEEP}""")
def grouped_cap_classes(spark, sf_dir):
    """The same for classes, of which one holds most rows: no task sees more than batches and states."""
    rows = read_table(spark, sf_dir, "documents", spread=True).select(
        "lang", F.col("doc_id").alias("id"), sample.order_key("doc_id", SEED).alias("h"))
    return grouped.combine_groups(rows, ["lang"], *_first(KEEP), "doc_id long, place long")


def _described(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents", spread=True).select("lang", "source", F.col("n_chars").alias("v"))
    return grouped.combine_groups(rows, ["lang", "source"], *_moments(), _DESCRIBED)


@query("grouped_describe", sql="""
SELECT lang, source, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS low,
       max(n_chars) AS high, round(avg(n_chars), 6) AS mean, round(var_samp(n_chars), 4) AS variance
FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source""")
def grouped_describe(spark, sf_dir):
    """A user's summary of every group of two keys."""
    out = _described(spark, sf_dir)
    return out.withColumn("mean", F.round("mean", 6)).withColumn("variance", F.round("variance", 4))


@query("grouped_deviation", sql="""
WITH g AS (SELECT lang, source, avg(n_chars) AS mean FROM documents
           WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source)
SELECT doc_id, round(n_chars - mean, 6) AS deviation FROM documents JOIN g USING (lang, source)""")
def grouped_deviation(spark, sf_dir):
    """Every row against its group, by a function of batches of rows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")

    def deviation(frame):
        return frame.assign(deviation=frame["n_chars"] - frame["mean"])[["doc_id", "deviation"]]

    out = grouped.map_with_groups(docs, ["lang", "source"], _described(spark, sf_dir), deviation,
                                  "doc_id long, deviation double")
    return out.withColumn("deviation", F.round("deviation", 6))
