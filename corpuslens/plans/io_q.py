"""Sources and sinks (S1, S2, P1) and first rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..schema import POSTS
from ..session import ensure_checkpoint_dir
from ..sources import infer
from ..sources.io import documents_as_posts, read_posts, read_table, write_posts
from .registry import query

FIRST_N = 10


@query("posts_csv_roundtrip", sql="""
SELECT doc_id, source AS author_id, text AS post, lang AS class FROM documents""")
def posts_csv_roundtrip(spark, sf_dir):
    """Write the posts table as CSV (header, quoted multi-line fields) into the
    shared checkpoint folder and read it back with the fixed schema."""
    posts = documents_as_posts(read_table(spark, sf_dir, "documents"))
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/csv/{uuid.uuid4().hex}"
    write_posts(posts, path, fmt="csv")
    return read_posts(spark, path, fmt="csv", schema=POSTS)


_KINDS = ("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "doc_id", "n_chars", "quality", "lang", "mixed")


def _types_sql() -> str:
    """The same counts by DuckDB: a long table of (column, value), then one aggregation."""
    def has(t):
        shape = f"regexp_matches(v, '{infer.SHAPES[t]}')"
        return f"({shape} AND TRY_CAST(v AS {t.upper()}) IS NOT NULL)" if t in ("date", "timestamp") else shape

    def first(of, otherwise):
        return "CASE " + " ".join(f"WHEN {of(t)}" for t in infer.TYPES) + f" ELSE {otherwise} END"

    counts = ", ".join(f"count(*) FILTER ({has(t)}) AS n_{t}, min(v) FILTER (NOT {has(t)}) AS not_{t}"
                       for t in infer.TYPES)
    most = "greatest(" + ", ".join(f"n_{t}" for t in infer.TYPES) + ")"
    return f"""
WITH t AS ({_TYPES_INPUT}),
texts AS (SELECT {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _KINDS)} FROM t),
long AS (SELECT column_name, v FROM texts UNPIVOT INCLUDE NULLS (v FOR column_name IN ({", ".join(_KINDS)}))),
c AS (SELECT column_name, count(v) AS n_values, count(*) - count(v) AS n_null, {counts} FROM long GROUP BY column_name)
SELECT column_name, {first(lambda t: f"n_{t} = n_values AND n_values > 0 THEN '{t}'", "'string'")} AS type, n_values, n_null,
       {", ".join(f"n_{t}" for t in infer.TYPES)},
       CASE WHEN {most} > 0 THEN {first(lambda t: f"n_{t} = {most} THEN '{t}'", "NULL")} END AS likely,
       CASE WHEN {most} > 0 THEN n_values - {most} END AS n_against,
       CASE WHEN {most} > 0 THEN {first(lambda t: f"n_{t} = {most} THEN not_{t}", "NULL")} END AS against
FROM c"""


# Orders beside documents and labels, as texts; ``mixed`` has numbers in most rows and words in the others.
_TYPES_INPUT = """SELECT o_orderkey, o_orderdate, o_totalprice, o_orderstatus, doc_id, n_chars, quality, lang,
CASE WHEN o_orderkey % 10 = 0 THEN o_orderstatus ELSE CAST(o_orderkey AS VARCHAR) END AS mixed
FROM orders LEFT JOIN documents ON doc_id = o_orderkey LEFT JOIN labels USING (doc_id)"""


@query("csv_types", sql=_types_sql())
def csv_types(spark, sf_dir):
    """Types of the columns of a table of texts, read back from CSV without a schema."""
    from pyspark.sql import DataFrame

    tables = {n: read_table(spark, sf_dir, n) for n in ("orders", "documents", "labels")}
    joined: DataFrame = spark.sql(
        _TYPES_INPUT.replace("FROM orders", "FROM {orders}").replace("JOIN documents", "JOIN {documents}")
        .replace("JOIN labels", "JOIN {labels}").replace("VARCHAR", "STRING"), **tables)
    texts = joined.select(*[F.col(c).cast("string").alias(c) for c in _KINDS])
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/csv/{uuid.uuid4().hex}"
    write_posts(texts, path, fmt="csv")
    return infer.evidence(read_posts(spark, path, fmt="csv", schema=None))


@query("first_posts", sql=f"""
SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT {FIRST_N}""")
def first_posts(spark, sf_dir):
    """The first rows by id (an explicit order, unlike an unordered head)."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", "n_chars").orderBy(F.col("doc_id")).limit(FIRST_N)
