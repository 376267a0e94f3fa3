"""Profiling and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, profile, quantiles, sample
from ..session import materialize
from ..sources.io import read_table
from .registry import query

SEED = 42
Q = 0.95


def _md5(id_expr: str) -> str:
    return f"md5(concat_ws('|', CAST({id_expr} AS VARCHAR), '{SEED}'))"


def _hint(expr: str, digits: int = 8) -> str:
    return f"CAST(('0x' || substr({expr}, 1, {digits})) AS BIGINT)"


@query("class_fractions", sql="""
SELECT lang, count(*) AS n,
       round(count(*) / (SELECT count(*) FROM documents WHERE lang IS NOT NULL), 9) AS fraction
FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def class_fractions(spark, sf_dir):
    out = profile.value_fractions(read_table(spark, sf_dir, "documents"), "lang")
    return out.select("lang", "n", F.round("fraction", 9).alias("fraction"))


@query("group_sizes", sql="""
SELECT o_custkey, count(*) AS n_posts FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey""")
def group_sizes(spark, sf_dir):
    return profile.group_sizes(read_table(spark, sf_dir, "orders"), "o_custkey")


def _stats_sql(table: str, key: str) -> str:
    return f"""
WITH s AS (SELECT {key}, count(*) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY {key})
SELECT count(*) AS n_groups, min(n) AS min_size, max(n) AS max_size,
       round(avg(n), 9) AS mean_size, round(quantile_cont(n, 0.5), 9) AS median_size,
       round(quantile_cont(n, {Q}), 9) AS pct_size FROM s"""


def _stats(spark, sf_dir, table, key):
    st = profile.size_stats(profile.group_sizes(read_table(spark, sf_dir, table), key), q=Q)
    return st.select("n_groups", "min_size", "max_size",
                     *[F.round(c, 9).alias(c) for c in ("mean_size", "median_size", "pct_size")])


@query("group_size_stats", sql=_stats_sql("orders", "o_custkey"))
def group_size_stats(spark, sf_dir):
    return _stats(spark, sf_dir, "orders", "o_custkey")


@query("group_size_stats_events", sql=_stats_sql("events", "user_id"))
def group_size_stats_events(spark, sf_dir):
    return _stats(spark, sf_dir, "events", "user_id")


_PROFILE_COLS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                 ("source", "string"), ("n_chars", "bigint"), ("quality", "int"),
                 ("toxic", "int")]


def _profile_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, '{t}' AS data_type, "
        f"count({'d' if c in ('doc_id',) else 'j'}.{c}) AS non_null, count(*) AS rows FROM j"
        for i, (c, t) in enumerate(_PROFILE_COLS))
    parts = parts.replace("count(d.doc_id)", "count(j.doc_id)")
    return f"""
WITH j AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
{parts}"""


@query("column_profile", sql=_profile_sql())
def column_profile(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left").select(*[c for c, _ in _PROFILE_COLS])
    return profile.info(joined)


_QS = (0.05, 0.5, 0.95)
#: Rows of a sketch: few, so that most of the larger tables' rows are left out.
SKETCH = 256
DELTA = 0.01


@query("quantiles_merged", sql=f"""
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY {_md5('doc_id')}, doc_id) AS rn
           FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL),
s AS (SELECT lang, count(*) AS n,
             quantile_cont(CAST(n_chars AS DOUBLE), {list(_QS)}) FILTER (rn <= {SKETCH}) AS vs FROM r GROUP BY lang),
u AS (SELECT lang, n, unnest(CAST({list(_QS)} AS DOUBLE[])) AS q, unnest(vs) AS v FROM s)
SELECT lang, n, q, round(v, 6) AS value,
       round(CASE WHEN n > {SKETCH} THEN sqrt(ln(2 / {DELTA}) / (2.0 * {SKETCH})) ELSE 0.0 END, 9) AS rank_error
FROM u""")
def quantiles_merged(spark, sf_dir):
    """Quantiles of lengths per class from sketches stored per class and source, then merged."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    stored = materialize(quantiles.sketch(docs, ["lang", "source"], "n_chars", "doc_id", SKETCH, SEED))
    out = quantiles.quantiles(quantiles.merge(stored, ["lang"], SKETCH), ["lang"], list(_QS), DELTA)
    return out.withColumn("value", F.round("value", 6)).withColumn("rank_error", F.round("rank_error", 9))


@query("cap_per_group", sql=f"""
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1),
k AS (SELECT CAST(floor(quantile_cont(n, {Q})) AS BIGINT) AS k FROM s),
r AS (SELECT o_orderkey, o_custkey,
             row_number() OVER (PARTITION BY o_custkey ORDER BY {_md5('o_orderkey')}, o_orderkey) AS rn
      FROM orders WHERE o_custkey IS NOT NULL)
SELECT o_orderkey, o_custkey FROM r WHERE rn <= (SELECT k FROM k)""")
def cap_per_group(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sample.cap_per_group(orders, "o_custkey", "o_orderkey", q=Q, seed=SEED)


@query("cap_per_group_events", sql=f"""
WITH s AS (SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1),
k AS (SELECT CAST(floor(quantile_cont(n, {Q})) AS BIGINT) AS k FROM s),
r AS (SELECT event_id, user_id,
             row_number() OVER (PARTITION BY user_id ORDER BY {_md5('event_id')}, event_id) AS rn
      FROM events WHERE user_id IS NOT NULL)
SELECT event_id, user_id FROM r WHERE rn <= (SELECT k FROM k)""")
def cap_per_group_events(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    return sample.cap_per_group(ev, "user_id", "event_id", q=Q, seed=SEED)


_RANKED = f"""
sz AS (SELECT lang, count(*) AS size FROM documents WHERE lang IS NOT NULL GROUP BY lang),
r AS (SELECT doc_id, lang,
             row_number() OVER (PARTITION BY lang ORDER BY {_md5('doc_id')}, doc_id) AS rn
      FROM documents WHERE lang IS NOT NULL)"""


def _draw_sql(need: str) -> str:
    pos = _hint("md5(concat_ws('|', d.lang, CAST(d.draw AS VARCHAR), '" + str(SEED) + "'))", 15)
    return f"""
need AS (SELECT lang, size, {need} AS need FROM sz),
d AS (SELECT lang, size, unnest(range(0, need)) AS draw FROM need WHERE need > 0),
dp AS (SELECT lang, draw, {pos} % size AS pos FROM d)"""


@query("balance_down", sql=f"""
WITH {_RANKED}
SELECT doc_id, lang FROM r WHERE rn <= (SELECT min(size) FROM sz)""")
def balance_down(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sample.balance(docs, "lang", "doc_id", how="down", seed=SEED)


@query("balance_bootstrap", sql=f"""
WITH {_RANKED}, {_draw_sql('(SELECT min(size) FROM sz)')}
SELECT r.doc_id, r.lang, dp.draw FROM dp JOIN r ON r.lang = dp.lang AND r.rn - 1 = dp.pos""")
def balance_bootstrap(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sample.balance(docs, "lang", "doc_id", how="bootstrap", seed=SEED)


@query("balance_up", sql=f"""
WITH {_RANKED}, {_draw_sql('(SELECT max(size) FROM sz) - size')}
SELECT r.doc_id, r.lang, dp.draw FROM dp JOIN r ON r.lang = dp.lang AND r.rn - 1 = dp.pos
UNION ALL
SELECT doc_id, lang, CAST(NULL AS BIGINT) AS draw FROM r""")
def balance_up(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sample.balance(docs, "lang", "doc_id", how="up", seed=SEED)


@query("hash_split", sql=f"""
SELECT doc_id, CASE WHEN {_hint(_md5('doc_id'))} % 10000 < 8000 THEN 'train' ELSE 'test' END AS split
FROM documents""")
def hash_split(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return sample.hash_split(docs, "doc_id", 0.8, seed=SEED)


@query("label_encode", sql="""
WITH c AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL),
k AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS label FROM c)
SELECT d.doc_id, d.lang, k.label FROM documents d LEFT JOIN k ON d.lang = k.lang""")
def label_encode(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return features.label_encode(docs, "lang")
