"""TF-IDF document vectors, class centroids and centroid-based biased words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bias, sample, tfidf
from ..sources.io import read_table
from .bias_q import n_classes, sql_max_other, sql_vocab
from .registry import query

SEED = 42
MAX_FEATURES = 1000
TOP_N = 10
REL_THRESHOLD = 1.0

SPLIT_SQL = (f"CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), "
             f"'{SEED}')), 1, 8)) AS BIGINT) % 10000 < 8000 THEN 'train' ELSE 'test' END")


def split_docs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread=True)
    docs = docs.select("doc_id", F.col("lang").alias("class"), "text",
                       tfidf.vector_terms("text").alias("tokens"))
    return sample.hash_split(docs, "doc_id", 0.8, seed=SEED)


def fitted(spark, sf_dir):
    """Vocabulary of the training split (max_features terms, min_df 1)."""
    d = split_docs(spark, sf_dir)
    model = tfidf.fit(d.where(F.col("split") == "train"), "tokens", max_features=MAX_FEATURES)
    return d, model


def _base_sql() -> str:
    return f"""
docs AS (SELECT doc_id, lang AS class, {SPLIT_SQL} AS split,
                regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS toks FROM documents),
tr AS (SELECT * FROM docs WHERE split = 'train'),
{sql_vocab('global', min_df=1, max_features=MAX_FEATURES, docs='tr')},
vi AS (SELECT term, idf, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS feature_idx FROM v),
dt AS (SELECT doc_id, class, unnest(toks) AS term FROM docs),
tf AS (SELECT doc_id, class, term, count(*) AS tf FROM dt GROUP BY 1, 2, 3),
w AS (SELECT doc_id, class, term, feature_idx, tf * idf AS w FROM tf JOIN vi USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id),
lw AS (SELECT doc_id, class, term, feature_idx, w / nrm AS weight FROM w JOIN nrm USING (doc_id))"""


@query("tfidf_vectors", sql=f"""
WITH {_base_sql()}
SELECT doc_id, term, feature_idx, round(weight, 9) AS weight FROM lw""")
def tfidf_vectors(spark, sf_dir):
    d, model = fitted(spark, sf_dir)
    lw = tfidf.long_weights(d, model, "doc_id", "tokens")
    return lw.select("doc_id", "term", "feature_idx", F.round("weight", 9).alias("weight"))


def _centroid_sql() -> str:
    return f"""{_base_sql()},
nc AS (SELECT class, count(*) AS n FROM docs WHERE class IS NOT NULL GROUP BY class),
cen AS (SELECT class, term, sum(weight) / any_value(nc.n) AS mean_tfidf
        FROM lw JOIN nc USING (class) GROUP BY class, term)"""


@query("class_centroid_top", sql=f"""
WITH {_centroid_sql()}
SELECT class, term, round(mean_tfidf, 9) AS mean_tfidf, rank FROM (
  SELECT class, term, mean_tfidf,
         CAST(row_number() OVER (PARTITION BY class ORDER BY mean_tfidf DESC, term) AS BIGINT) AS rank
  FROM cen) WHERE rank <= {TOP_N}""")
def class_centroid_top(spark, sf_dir):
    d, model = fitted(spark, sf_dir)
    cen = tfidf.class_centroid(d, model, "doc_id", "class")
    top = tfidf.top_terms(cen, TOP_N, by="mean_tfidf")
    return top.select("class", "term", F.round("mean_tfidf", 9).alias("mean_tfidf"), "rank")


@query("biased_words_rel", sql=f"""
WITH {_centroid_sql()}, {sql_max_other('cen', 'mean_tfidf')},
rel AS (SELECT *, CASE WHEN max_other > 0 THEN (score - max_other) / max_other
                       WHEN score > 0 THEN CAST('inf' AS DOUBLE) END AS rel_diff FROM mo2)
SELECT class, term, round(score, 9) AS score, round(max_other, 9) AS max_other,
       CASE WHEN isinf(rel_diff) THEN rel_diff ELSE round(rel_diff, 6) END AS rel_diff
FROM rel WHERE rel_diff > {REL_THRESHOLD}""")
def biased_words_rel(spark, sf_dir):
    """Relative-gap biased words over mean TF-IDF per class (infinite when no other class has it)."""
    d, model = fitted(spark, sf_dir)
    cen = tfidf.class_centroid(d, model, "doc_id", "class").withColumnRenamed("mean_tfidf", "score")
    out = bias.biased_words(cen, n_classes(spark, sf_dir), mode="rel", threshold=REL_THRESHOLD)
    rel = F.when(F.isnan(F.col("rel_diff")) | (F.abs(F.col("rel_diff")) == float("inf")),
                 F.col("rel_diff")).otherwise(F.round("rel_diff", 6))
    return out.select("class", "term", F.round("score", 9).alias("score"),
                      F.round("max_other", 9).alias("max_other"), rel.alias("rel_diff"))


@query("biased_words_ranked", sql=f"""
WITH {_centroid_sql()}, {sql_max_other('cen', 'mean_tfidf')},
rel AS (SELECT *, CASE WHEN max_other > 0 THEN (score - max_other) / max_other
                       WHEN score > 0 THEN CAST('inf' AS DOUBLE) END AS rel_diff FROM mo2),
r2 AS (SELECT class, term, CASE WHEN isinf(rel_diff) THEN rel_diff ELSE round(rel_diff, 6) END AS rel_diff
       FROM rel WHERE rel_diff > {REL_THRESHOLD})
SELECT class, term, rel_diff, CAST(row_number() OVER (PARTITION BY class ORDER BY rel_diff DESC, term)
                                   AS BIGINT) AS rank FROM r2""")
def biased_words_ranked(spark, sf_dir):
    """The biased words in order of their relative gap within the class (T5)."""
    return bias.ranked(biased_words_rel(spark, sf_dir)).select("class", "term", "rel_diff", "rank")
