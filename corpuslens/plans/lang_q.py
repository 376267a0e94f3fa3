"""Language detection and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, lang, sample
from ..sources.io import read_table
from .registry import query
from .tfidf_q import SEED, SPLIT_SQL


def detected(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", "lang", "text")
    docs = sample.hash_split(docs, "doc_id", 0.8, seed=SEED)
    profile, priors = lang.fit_profiles(docs.where(F.col("split") == "train"),
                                        "doc_id", "text", "lang")
    return lang.detect(docs.where(F.col("split") == "test"), "doc_id", "text",
                       profile, priors, keep=["lang"])


_DETECT_SQL = f"""
docs AS (SELECT doc_id, lang, lower(text) AS t, {SPLIT_SQL} AS split FROM documents),
g AS (SELECT doc_id, lang, split,
             unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS term
      FROM docs WHERE length(t) >= 3),
prof AS (SELECT lang, term, count(*) AS c FROM g WHERE split = 'train' AND lang IS NOT NULL
         GROUP BY lang, term),
pri AS (SELECT lang, sum(c) AS n_lang FROM prof GROUP BY lang),
vv AS (SELECT count(DISTINCT term) AS v FROM prof),
tg AS (SELECT doc_id, term, count(*) AS k FROM g WHERE split = 'test' GROUP BY doc_id, term),
kk AS (SELECT doc_id, greatest(length(t) - 2, 0) AS kt FROM docs WHERE split = 'test'),
gain AS (SELECT tg.doc_id, prof.lang, sum(tg.k * ln(prof.c + 1.0)) AS gain
         FROM tg JOIN prof USING (term) GROUP BY tg.doc_id, prof.lang),
grid AS (SELECT kk.doc_id, kk.kt, pri.lang, pri.n_lang FROM kk, pri),
sc AS (SELECT grid.doc_id, grid.lang,
              coalesce(gain.gain, 0) - grid.kt * ln(grid.n_lang + (SELECT v FROM vv)) AS score
       FROM grid LEFT JOIN gain ON gain.doc_id = grid.doc_id AND gain.lang = grid.lang),
best AS (SELECT doc_id, lang AS predicted, score,
                row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS rn FROM sc),
pred AS (SELECT d.doc_id, d.lang, b.predicted, b.score
         FROM docs d JOIN best b ON b.doc_id = d.doc_id AND b.rn = 1 WHERE d.split = 'test')"""


@query("lang_detect", sql=f"""
WITH {_DETECT_SQL}
SELECT doc_id, lang, predicted, round(score, 4) AS score FROM pred""")
def lang_detect(spark, sf_dir):
    d = detected(spark, sf_dir)
    return d.select("doc_id", "lang", "predicted", F.round("score", 4).alias("score"))


@query("confusion_matrix", sql=f"""
WITH {_DETECT_SQL}
SELECT lang AS label, predicted AS prediction, count(*) AS n FROM pred GROUP BY 1, 2""")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(detected(spark, sf_dir), "lang", "predicted")


@query("confusion_matrix_wide", sql=f"""
WITH {_DETECT_SQL}
SELECT lang AS label, count(*) FILTER (predicted = 'de') AS de, count(*) FILTER (predicted = 'en') AS en,
       count(*) FILTER (predicted = 'es') AS es, count(*) FILTER (predicted = 'fr') AS fr
FROM pred GROUP BY lang""")
def confusion_matrix_wide(spark, sf_dir):
    """Rows: true class; a column per predicted class (A16, wide)."""
    return evaluate.confusion_wide(detected(spark, sf_dir), None, "lang", "predicted")


@query("accuracy", sql=f"""
WITH {_DETECT_SQL}
SELECT count(*) AS n, round(avg(CASE WHEN lang = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM pred""")
def accuracy(spark, sf_dir):
    a = evaluate.accuracy(detected(spark, sf_dir), "lang", "predicted")
    return a.select("n", F.round("accuracy", 9).alias("accuracy"))


@query("class_report", sql=f"""
WITH {_DETECT_SQL},
cm AS (SELECT lang AS label, predicted AS prediction, count(*) AS n FROM pred GROUP BY 1, 2),
cls AS (SELECT label AS cls FROM cm UNION SELECT prediction FROM cm),
t AS (SELECT cls,
             coalesce((SELECT sum(n) FROM cm WHERE label = cls AND prediction = cls), 0) AS tp,
             coalesce((SELECT sum(n) FROM cm WHERE label = cls), 0) AS support,
             coalesce((SELECT sum(n) FROM cm WHERE prediction = cls), 0) AS predicted FROM cls),
per AS (SELECT cls AS class,
               CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
               CAST(support AS BIGINT) AS support FROM t),
per2 AS (SELECT *, CASE WHEN precision + recall > 0
                        THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per),
allr AS (
  SELECT class, precision, recall, support, f1 FROM per2
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), CAST(sum(support) AS BIGINT), avg(f1) FROM per2
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                   sum(recall * support) / sum(support), CAST(sum(support) AS BIGINT),
                   sum(f1 * support) / sum(support) FROM per2)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, support,
       round(f1, 9) AS f1 FROM allr""")
def class_report(spark, sf_dir):
    r = evaluate.report(detected(spark, sf_dir), "lang", "predicted")
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall")],
                    "support", F.round("f1", 9).alias("f1"))


_BATCH_SQL = f"""
docs AS (SELECT doc_id, lang, lower(text) AS t, {SPLIT_SQL} AS split FROM documents),
g AS (SELECT doc_id, lang, split,
             unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS term
      FROM docs WHERE length(t) >= 3),
h AS (SELECT doc_id, lang, split, term, CAST(('0x' || substr(md5(term), 1, 4)) AS INTEGER) AS b FROM g),
prof AS (SELECT lang, b, count(*) AS c FROM h WHERE split = 'train' AND lang IS NOT NULL GROUP BY lang, b),
pri AS (SELECT lang, ln(sum(c) + 65536) AS lognv FROM prof GROUP BY lang),
tg AS (SELECT doc_id, b, count(*) AS k FROM h WHERE split = 'test' GROUP BY doc_id, b),
te AS (SELECT doc_id, lang FROM docs WHERE split = 'test'),
sc AS (SELECT te.doc_id, pri.lang,
              coalesce((SELECT sum(k) FROM tg WHERE tg.doc_id = te.doc_id), 0) * -pri.lognv
              + coalesce((SELECT sum(tg.k * ln(prof.c + 1.0)) FROM tg JOIN prof ON prof.b = tg.b
                          AND prof.lang = pri.lang WHERE tg.doc_id = te.doc_id), 0) AS score
       FROM te, pri),
best AS (SELECT doc_id, lang AS predicted,
                row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS rn FROM sc)"""


@query("lang_detect_batch", sql=f"""
WITH {_BATCH_SQL}
SELECT te.doc_id, te.lang, best.predicted FROM te JOIN best ON best.doc_id = te.doc_id AND best.rn = 1""")
def lang_detect_batch(spark, sf_dir):
    """A hashed trigram model, of fixed size, run as a user model through batched inference
    (model built once per Python worker, texts scored in Arrow batches)."""
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", "lang", "text")
    docs = sample.hash_split(docs, "doc_id", 0.8, seed=SEED)
    counts = lang.hashed_profile(docs.where(F.col("split") == "train"), "text", "lang")
    test = docs.where(F.col("split") == "test")
    return lang.detect_with(test, "text", lang.hashed_model(counts), out="predicted").select(
        "doc_id", "lang", "predicted")
