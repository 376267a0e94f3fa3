"""Vocabulary, IDF and biased-word queries over ``documents`` (class = lang)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bias, tfidf
from ..sources.io import read_table
from .registry import query

# The vectoriser settings of the class-wise analysis.
MIN_DF = 5
MAX_FEATURES = 5000
ABS_THRESHOLD = 0.5
TOP_N = 10
# Terms looked up side by side (one frequent in several classes, one in a
# single class, one absent everywhere).
COMPARE_TERMS = ("the", "und", "government")


def class_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", spread=True)
    return docs.select("doc_id", F.col("lang").alias("class"),
                       tfidf.vector_terms("text").alias("tokens"))


def class_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.idf_by(class_tokens(spark, sf_dir), "tokens", "class",
                        min_df=MIN_DF, max_features=MAX_FEATURES)


def global_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.idf(class_tokens(spark, sf_dir), "tokens",
                     min_df=MIN_DF, max_features=MAX_FEATURES)


def n_classes(spark: SparkSession, sf_dir: str):
    docs = read_table(spark, sf_dir, "documents")
    return docs.where(F.col("lang").isNotNull()).select(F.countDistinct("lang")).scalar()


# ---------------------------------------------------------------- SQL pieces

def sql_docs() -> str:
    return (r"docs AS (SELECT doc_id, lang AS class, "
            r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS toks "
            r"FROM documents WHERE lang IS NOT NULL)")


def sql_vocab(scope: str = "class", min_df: int = MIN_DF, max_features: int = MAX_FEATURES,
              docs: str = "docs", p: str = "") -> str:
    """CTEs ending in ``{p}v(class, term, df, tf, n_docs, idf)``; ``p`` prefixes names."""
    sc = "class" if scope == "class" else "'__all__'"
    return f"""
{p}n AS (SELECT {sc} AS class, count(*) AS n_docs FROM {docs} GROUP BY 1),
{p}tok AS (SELECT doc_id, {sc} AS class, unnest(toks) AS term FROM {docs}),
{p}st AS (SELECT class, term, count(DISTINCT doc_id) AS df, count(*) AS tf
       FROM {p}tok GROUP BY class, term HAVING count(DISTINCT doc_id) >= {min_df}),
{p}r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY tf DESC, term ASC) AS rn
       FROM {p}st),
{p}v AS (SELECT r.class, r.term, r.df, r.tf, n.n_docs,
             ln((1.0 + n.n_docs) / (1.0 + r.df)) + 1 AS idf
      FROM {p}r AS r JOIN {p}n AS n USING (class) WHERE rn <= {max_features})"""


def sql_max_other(src: str, score: str) -> str:
    """CTE ``mo(class, term, score, max_other)`` over ``src(class, term, {score})``."""
    return f"""
k AS (SELECT count(DISTINCT lang) AS k FROM documents WHERE lang IS NOT NULL),
mo AS (SELECT a.class, a.term, a.{score} AS score,
              max(b.{score}) AS best_other, count(b.class) + 1 AS present
       FROM {src} a LEFT JOIN {src} b ON a.term = b.term AND a.class <> b.class
       GROUP BY a.class, a.term, a.{score}),
mo2 AS (SELECT class, term, score,
               CASE WHEN present < (SELECT k FROM k) THEN greatest(coalesce(best_other, 0), 0)
                    ELSE coalesce(best_other, 0) END AS max_other
        FROM mo)"""


# ---------------------------------------------------------------- queries

@query("idf_by_class", sql=f"""
WITH {sql_docs()}, {sql_vocab('class')}
SELECT class, term, df, CAST(tf AS BIGINT) AS tf, n_docs, round(idf, 9) AS idf FROM v""")
def idf_by_class(spark, sf_dir):
    v = class_vocab(spark, sf_dir)
    return v.select("class", "term", F.col("df").cast("bigint").alias("df"),
                    F.col("tf").cast("bigint").alias("tf"),
                    F.col("n_docs").cast("bigint").alias("n_docs"),
                    F.round("idf", 9).alias("idf"))


@query("idf_global", sql=f"""
WITH {sql_docs()}, {sql_vocab('global')}
SELECT term, df, CAST(tf AS BIGINT) AS tf, n_docs, round(idf, 9) AS idf FROM v""")
def idf_global(spark, sf_dir):
    v = global_vocab(spark, sf_dir)
    return v.select("term", F.col("df").cast("bigint").alias("df"),
                    F.col("tf").cast("bigint").alias("tf"),
                    F.col("n_docs").cast("bigint").alias("n_docs"),
                    F.round("idf", 9).alias("idf"))


@query("biased_words_abs", sql=f"""
WITH {sql_docs()}, {sql_vocab('class')}, {sql_max_other('v', 'idf')}
SELECT class, term, round(score, 9) AS score, round(max_other, 9) AS max_other
FROM mo2 WHERE score > max_other + {ABS_THRESHOLD}""")
def biased_words_abs(spark, sf_dir):
    v = class_vocab(spark, sf_dir).select("class", "term", F.col("idf").alias("score"))
    out = bias.biased_words(v, n_classes(spark, sf_dir), mode="abs", threshold=ABS_THRESHOLD)
    return out.select("class", "term", F.round("score", 9).alias("score"),
                      F.round("max_other", 9).alias("max_other"))


@query("top_idf_terms", sql=f"""
WITH {sql_docs()}, {sql_vocab('class')}
SELECT class, term, round(idf, 9) AS idf, rank FROM (
  SELECT class, term, idf,
         CAST(row_number() OVER (PARTITION BY class ORDER BY idf DESC, term ASC) AS BIGINT) AS rank
  FROM v) WHERE rank <= {TOP_N}""")
def top_idf_terms(spark, sf_dir):
    """Top-n terms by IDF per class (the rarest retained terms, as the reference ranks)."""
    v = class_vocab(spark, sf_dir)
    t = tfidf.top_terms(v, TOP_N, by="idf")
    return t.select("class", "term", F.round("idf", 9).alias("idf"), "rank")


@query("top_idf_terms_global", sql=f"""
WITH {sql_docs()}, {sql_vocab('global')}
SELECT term, round(idf, 9) AS idf, rank FROM (
  SELECT term, idf,
         CAST(row_number() OVER (ORDER BY idf DESC, term ASC) AS BIGINT) AS rank
  FROM v) WHERE rank <= {TOP_N}""")
def top_idf_terms_global(spark, sf_dir):
    v = tfidf.idf_by(class_tokens(spark, sf_dir), "tokens", None,
                     min_df=MIN_DF, max_features=MAX_FEATURES)
    t = tfidf.top_terms(v, TOP_N, by="idf")
    return t.select("term", F.round("idf", 9).alias("idf"), "rank")


@query("vocab_union", sql=f"""
WITH {sql_docs()}, {sql_vocab('class')}
SELECT term, CAST(count(DISTINCT class) AS BIGINT) AS n_classes FROM v GROUP BY term""")
def vocab_union(spark, sf_dir):
    return bias.vocab_union(class_vocab(spark, sf_dir))


def _compare_sql() -> str:
    terms = ", ".join(f"('{t}')" for t in COMPARE_TERMS)
    per_class = ",\n       ".join(
        f"round(max(CASE WHEN v.class = '{c}' THEN v.idf END), 9) AS score_{c}"
        for c in ("de", "en", "es", "fr"))
    return f"""
WITH {sql_docs()}, {sql_vocab('class')}, {sql_vocab('global', p='g')},
terms(term) AS (VALUES {terms})
SELECT t.term, round(any_value(gv.idf), 9) AS global_score,
       {per_class}
FROM terms t LEFT JOIN gv ON gv.term = t.term LEFT JOIN v ON v.term = t.term
GROUP BY t.term"""


@query("compare_terms", sql=_compare_sql())
def compare_terms(spark, sf_dir):
    classes = [r[0] for r in read_table(spark, sf_dir, "documents")
               .where(F.col("lang").isNotNull()).select("lang").distinct().collect()]
    terms = spark.createDataFrame([(t,) for t in COMPARE_TERMS], "term string")
    vocab = tfidf.idf_scopes(class_tokens(spark, sf_dir), "tokens", "class",
                             min_df=MIN_DF, max_features=MAX_FEATURES)
    out = bias.compare_scoped(vocab, terms, sorted(classes), global_scope=tfidf.GLOBAL)
    return out.select("term", *[F.round(c, 9).alias(c) for c in out.columns if c != "term"])
