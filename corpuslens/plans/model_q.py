"""Training, evaluation and explanation queries."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions.text import explode_terms, vector_terms
from ..operators import (bias, clean, evaluate, explain, features, permutation, sample,
                         softboost, tfidf, train)
from ..session import materialize
from ..sources.io import read_table
from .bias_q import sql_max_other, sql_vocab
from .registry import query
from .tfidf_q import MAX_FEATURES, SEED, SPLIT_SQL

TOP_N = 10
REL_THRESHOLD = 1.0
NUM_TREES = 100


def model_table(spark, sf_dir):
    """Clean table: basic-cleaned text, its tokens and counts, label code, split."""
    docs = read_table(spark, sf_dir, "documents", spread=True).select(
        "doc_id", F.col("lang").alias("class"), "text")
    docs = clean.clean_table(docs, "text", "basic")
    docs = features.label_encode(docs, "class", "label")
    docs = docs.withColumn("tokens", vector_terms("clean_post"))
    docs = docs.withColumn("label", F.col("label").cast("double"))
    return sample.hash_split(docs, "doc_id", 0.8, seed=SEED)


def feature_table(d, space):
    """(feature table, feature space) of a clean table whose ``tokens`` hold no spaces.

    The vocabulary and the vectors both need the tokens: they are made once and kept as text
    joined by spaces, which takes a fraction of an array's space, until the vectors are written
    to the shared checkpoint folder. Every model fit and scoring pass reads those; the table
    holds no tokens."""
    kept = d.select("doc_id", "class", "label", "split", *features.NUMERIC_FEATURES,
                    F.size("tokens").alias("_n"), F.array_join("tokens", " ").alias("_joined"))
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    # One empty token and none are joined alike; a NULL list stays NULL.
    tokens = F.when(F.col("_n") == 0, F.array().cast("array<string>")).otherwise(F.split("_joined", " ", -1))
    d = kept.withColumn("tokens", tokens).drop("_n", "_joined")
    model = tfidf.fit(d.where(F.col("split") == "train"), "tokens", max_features=MAX_FEATURES)
    fs = space(model)
    table = materialize(fs.transform(d).select("doc_id", "class", "label", "split", "features"))
    kept.unpersist()
    return table, fs


def prepared(spark, sf_dir):
    """Feature table (sparse TF-IDF + counts) and its space."""
    return feature_table(model_table(spark, sf_dir), train.feature_space)


def fitted_forest(spark, sf_dir):
    d, fs = prepared(spark, sf_dir)
    d = d.where(F.col("label").isNotNull())  # a NULL class neither trains nor scores
    rf = train.forest(d.where(F.col("split") == "train"), num_trees=NUM_TREES, seed=SEED)
    return d, fs, rf


@query("forest_accuracy")
def forest_accuracy(spark, sf_dir):
    """Random forest (100 trees) on TF-IDF + counts; held-out accuracy."""
    d, _, rf = fitted_forest(spark, sf_dir)
    pred = rf.transform(d.where(F.col("split") == "test"))
    return evaluate.accuracy(pred, "label", "prediction")


@query("forest_report")
def forest_report(spark, sf_dir):
    d, _, rf = fitted_forest(spark, sf_dir)
    pred = rf.transform(d.where(F.col("split") == "test"))
    return evaluate.report(pred, "label", "prediction")


@query("forest_importance")
def forest_importance(spark, sf_dir):
    _, fs, rf = fitted_forest(spark, sf_dir)
    imp = explain.importance(spark, rf, fs.names)
    return explain.top_features(imp.withColumn("class", F.lit("all")), TOP_N,
                                score_col="importance")


@query("gain_importance")
def gain_importance(spark, sf_dir):
    """Top features by mean split gain, read from the saved tree nodes."""
    _, fs, rf = fitted_forest(spark, sf_dir)
    nodes = explain.node_table(spark, rf)
    g = explain.gain_importance(nodes, explain.names_table(spark, fs.names))
    return explain.top_features(g.withColumn("class", F.lit("all")), TOP_N, score_col="gain")


@query("interactions")
def interactions(spark, sf_dir):
    _, fs, rf = fitted_forest(spark, sf_dir)
    nodes = explain.node_table(spark, rf)
    return explain.interactions(nodes, explain.names_table(spark, fs.names))


def feature_entries(df, fs):
    """(doc_id, feature_idx, value): the non-zero entries of the feature vectors over ``fs``."""
    at, values = softboost.entries("features")
    return df.select("doc_id", F.inline(F.arrays_zip(at.alias("feature_idx"), values.alias("value")))) \
             .where(F.col("value") != 0)


@query("logistic_attribution_top")
def logistic_attribution_top(spark, sf_dir):
    """Exact linear attributions of a multinomial logistic regression, top 10 per class."""
    d, fs = prepared(spark, sf_dir)
    d = d.where(F.col("label").isNotNull())
    lr = train.logistic(d.where(F.col("split") == "train"))
    codes = [r["class"] for r in features.class_codes(d, "class").orderBy("label").collect()]
    coef = explain.coefficient_table(spark, lr, codes)
    test = d.where(F.col("split") == "test")
    n_test = test.select(F.count(F.lit(1))).scalar()
    ma = explain.linear_mean_abs(feature_entries(test, fs), coef, n_test)
    named = ma.join(F.broadcast(explain.names_table(spark, fs.names)), "feature_idx")
    return explain.top_features(named, TOP_N)


# ----------------------------------------------- closed-form presence model

def _presence_model(spark, sf_dir):
    """Documents, term presence, class log-odds weights and class sizes of the
    closed-form presence model (vocabulary: the training split's top terms)."""
    docs = read_table(spark, sf_dir, "documents", spread=True).select(
        "doc_id", F.col("lang").alias("class"), vector_terms("text").alias("tokens"))
    docs = sample.hash_split(docs, "doc_id", 0.8, seed=SEED)
    model = tfidf.fit(docs.where(F.col("split") == "train"), "tokens", max_features=MAX_FEATURES)
    vocab = F.broadcast(model.vocabulary(spark).select("term"))  # <= MAX_FEATURES rows
    gen, nonnull = explode_terms(F.array_distinct("tokens"))
    # Presence rows feed the weights, the explained entries and their counts:
    # written once instead of re-tokenising the corpus for each.
    pres = materialize(docs.select("doc_id", "class", "split", gen).where(nonnull)
                           .join(vocab, "term"))
    train_docs = docs.where((F.col("split") == "train") & F.col("class").isNotNull())
    sizes = train_docs.groupBy("class").agg(F.count(F.lit(1)).alias("n_c"))
    classes = sorted(r["class"] for r in sizes.select("class").collect())
    # The fitted weights are the model (classes x vocabulary): written once.
    w = materialize(explain.presence_weights(
        pres.where((F.col("split") == "train") & F.col("class").isNotNull()),
        sizes, "class", classes))
    return docs, pres, w, sizes, vocab


def _presence(spark, sf_dir):
    docs, pres, w, _, _ = _presence_model(spark, sf_dir)
    n_test = docs.where(F.col("split") == "test").select(F.count(F.lit(1))).scalar()
    return explain.presence_mean_abs(w, pres.where(F.col("split") == "test"), n_test)


def _presence_sql() -> str:
    return f"""
docs AS (SELECT doc_id, lang AS class, {SPLIT_SQL} AS split,
                regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS toks FROM documents),
tr AS (SELECT * FROM docs WHERE split = 'train'),
{sql_vocab('global', min_df=1, max_features=MAX_FEATURES, docs='tr')},
pres AS (SELECT DISTINCT d.doc_id, d.class, d.split, t.term
         FROM (SELECT doc_id, class, split, unnest(toks) AS term FROM docs) d JOIN v t USING (term)),
nc AS (SELECT class, count(*) AS n_c FROM tr WHERE class IS NOT NULL GROUP BY class),
nall AS (SELECT sum(n_c) AS n FROM nc),
dft AS (SELECT term, count(*) AS df_all FROM pres WHERE split = 'train' AND class IS NOT NULL
        GROUP BY term),
dfc AS (SELECT class, term, count(*) AS df_c FROM pres WHERE split = 'train' AND class IS NOT NULL
        GROUP BY class, term),
w AS (SELECT nc.class, dft.term,
             ln((coalesce(dfc.df_c, 0) + 1.0) / (nc.n_c + 2.0))
             - ln((dft.df_all - coalesce(dfc.df_c, 0) + 1.0) / ((SELECT n FROM nall) - nc.n_c + 2.0)) AS w
      FROM dft CROSS JOIN nc LEFT JOIN dfc ON dfc.class = nc.class AND dfc.term = dft.term),
nt AS (SELECT count(*) AS n FROM docs WHERE split = 'test'),
nz AS (SELECT term, count(*) AS nnz FROM pres WHERE split = 'test' GROUP BY term),
ma AS (SELECT w.class, w.term,
              (coalesce(nnz, 0) * abs(w * (1 - coalesce(nnz, 0) / (SELECT n FROM nt)))
               + ((SELECT n FROM nt) - coalesce(nnz, 0)) * abs(w * coalesce(nnz, 0) / (SELECT n FROM nt)))
              / (SELECT n FROM nt) AS mean_abs
       FROM w LEFT JOIN nz USING (term))"""


@query("linear_attribution_top", sql=f"""
WITH {_presence_sql()}
SELECT class, term, round(mean_abs, 9) AS mean_abs, rank FROM (
  SELECT class, term, mean_abs,
         CAST(row_number() OVER (PARTITION BY class ORDER BY mean_abs DESC, term) AS BIGINT) AS rank
  FROM ma) WHERE rank <= {TOP_N}""")
def linear_attribution_top(spark, sf_dir):
    """Mean |attribution| of a class log-odds presence model, top 10 terms per class."""
    ma = _presence(spark, sf_dir)
    top = explain.top_features(ma, TOP_N, feature_col="term")
    return top.select("class", "term", F.round("mean_abs", 9).alias("mean_abs"), "rank")


@query("biased_words_attribution", sql=f"""
WITH {_presence_sql()}, {sql_max_other('ma', 'mean_abs')},
rel AS (SELECT *, CASE WHEN max_other > 0 THEN (score - max_other) / max_other
                       WHEN score > 0 THEN CAST('inf' AS DOUBLE) END AS rel_diff FROM mo2)
SELECT class, term, round(score, 9) AS score, round(max_other, 9) AS max_other,
       CASE WHEN isinf(rel_diff) THEN rel_diff ELSE round(rel_diff, 6) END AS rel_diff
FROM rel WHERE rel_diff > {REL_THRESHOLD}""")
def biased_words_attribution(spark, sf_dir):
    """Relative-gap biased words over mean |attribution| per class."""
    from .bias_q import n_classes

    ma = _presence(spark, sf_dir).withColumnRenamed("mean_abs", "score")
    out = bias.biased_words(ma, n_classes(spark, sf_dir), mode="rel", threshold=REL_THRESHOLD)
    rel = F.when(F.abs(F.col("rel_diff")) == float("inf"), F.col("rel_diff")) \
           .otherwise(F.round("rel_diff", 6))
    return out.select("class", "term", F.round("score", 9).alias("score"),
                      F.round("max_other", 9).alias("max_other"), rel.alias("rel_diff"))


# ----------------------------------------------- permutation importance

PERM_REPEATS = 10


def _presence_permutation(spark, sf_dir):
    """Class-wise permutation importance of the presence model on the test split.

    Prediction: argmax_c ln(n_c / n) + sum of w(c, t) over the terms present.
    """
    docs, pres, w, sizes, vocab = _presence_model(spark, sf_dir)
    rows = docs.where((F.col("split") == "test") & F.col("class").isNotNull()) \
               .select("doc_id", F.col("class").alias("label"))
    entries = (pres.where(F.col("split") == "test").join(rows.select("doc_id"), "doc_id")
                   .select("doc_id", "term", F.lit(1.0).alias("value")))
    n_c = {r["class"]: r["n_c"] for r in sizes.collect()}   # one row per class
    total = sum(n_c.values())
    intercepts = {c: math.log(k / total) for c, k in n_c.items()}
    return permutation.permutation_importance(rows, entries, w, intercepts, vocab,
                                              n_repeats=PERM_REPEATS, seed=SEED,
                                              feature_col="term")


@query("permutation_importance", sql=f"""
WITH {_presence_sql()},
rws AS (SELECT doc_id, class AS label FROM docs WHERE split = 'test' AND class IS NOT NULL),
nr AS (SELECT count(*) AS n FROM rws),
b AS (SELECT class AS cls, ln(n_c / (SELECT n FROM nall)) AS b FROM nc),
ent AS (SELECT p.doc_id, p.term, 1.0 AS x FROM pres p JOIN rws USING (doc_id) WHERE p.split = 'test'),
contrib AS (SELECT e.doc_id, w.class AS cls, sum(e.x * w.w) AS s
            FROM ent e JOIN w ON w.term = e.term GROUP BY 1, 2),
sc AS (SELECT r.doc_id, b.cls, b.b + coalesce(c.s, 0) AS score
       FROM rws r CROSS JOIN b LEFT JOIN contrib c ON c.doc_id = r.doc_id AND c.cls = b.cls),
pr AS (SELECT doc_id, cls AS pred FROM (
         SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cls) AS rn FROM sc)
       WHERE rn = 1),
rk AS (SELECT doc_id, row_number() OVER (
         ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '{SEED}')), doc_id) - 1 AS rho FROM rws),
fr AS (SELECT term, rep,
              1 + CAST(('0x' || substr(md5(concat_ws('|', term, CAST(rep AS VARCHAR), '{SEED}')), 1, 15))
                       AS BIGINT) % ((SELECT n FROM nr) - 1) AS shift
       FROM (SELECT term FROM v) CROSS JOIN (SELECT unnest(range(0, {PERM_REPEATS})) AS rep)),
er AS (SELECT e.term, fr.rep, fr.shift, rk.rho, e.x FROM ent e JOIN rk USING (doc_id) JOIN fr USING (term)),
own AS (SELECT term, rep, rho, x AS x_own FROM er),
don AS (SELECT term, rep, (((rho - shift) % (SELECT n FROM nr)) + (SELECT n FROM nr)) % (SELECT n FROM nr) AS rho,
               x AS x_don FROM er),
ch AS (SELECT coalesce(o.term, d.term) AS term, coalesce(o.rep, d.rep) AS rep,
              coalesce(o.rho, d.rho) AS rho, coalesce(d.x_don, 0) - coalesce(o.x_own, 0) AS delta
       FROM own o FULL OUTER JOIN don d ON o.term = d.term AND o.rep = d.rep AND o.rho = d.rho),
ch2 AS (SELECT ch.term, ch.rep, rk.doc_id, ch.delta FROM ch JOIN rk USING (rho) WHERE ch.delta <> 0),
ns AS (SELECT ch2.term, ch2.rep, ch2.doc_id, sc.cls, sc.score + coalesce(w.w, 0) * ch2.delta AS score
       FROM ch2 JOIN sc USING (doc_id) LEFT JOIN w ON w.class = sc.cls AND w.term = ch2.term),
np AS (SELECT term, rep, doc_id, cls AS pred2 FROM (
         SELECT *, row_number() OVER (PARTITION BY term, rep, doc_id ORDER BY score DESC, cls) AS rn
         FROM ns) WHERE rn = 1),
fl AS (SELECT np.term, pr.pred AS cls, CASE WHEN r.label <> pr.pred THEN 1 ELSE -1 END AS d
       FROM np JOIN pr USING (doc_id) JOIN rws r USING (doc_id) WHERE np.pred2 <> pr.pred
       UNION ALL
       SELECT np.term, np.pred2 AS cls, CASE WHEN r.label = np.pred2 THEN 1 ELSE -1 END AS d
       FROM np JOIN pr USING (doc_id) JOIN rws r USING (doc_id) WHERE np.pred2 <> pr.pred),
g AS (SELECT cls, term, sum(d) AS gain FROM fl GROUP BY 1, 2),
imp AS (SELECT b.cls AS class, v.term,
               -coalesce(g.gain, 0) / ({PERM_REPEATS}.0 * (SELECT n FROM nr)) AS importance
        FROM v CROSS JOIN b LEFT JOIN g ON g.cls = b.cls AND g.term = v.term)
SELECT class, term, round(importance, 9) AS importance, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY class ORDER BY importance DESC, term) AS BIGINT)
            AS rank FROM imp) WHERE rank <= {TOP_N}""")
def permutation_importance(spark, sf_dir):
    """Top 10 terms per class by permutation importance (10 repeats) of the presence model."""
    imp = _presence_permutation(spark, sf_dir)
    top = explain.top_features(imp, TOP_N, feature_col="term", score_col="importance")
    return top.select("class", "term", F.round("importance", 9).alias("importance"), "rank")


@query("logistic_permutation")
def logistic_permutation(spark, sf_dir):
    """Top 10 features per class by permutation importance of the multinomial
    logistic regression (TF-IDF + counts), exact on the sparse entries."""
    d, fs = prepared(spark, sf_dir)
    d = d.where(F.col("label").isNotNull())
    lr = train.logistic(d.where(F.col("split") == "train"))
    codes = [r["class"] for r in features.class_codes(d, "class").orderBy("label").collect()]
    coef = explain.coefficient_table(spark, lr, codes)
    b = lr.interceptVector.toArray()
    intercepts = {codes[i]: float(b[i]) for i in range(len(codes))}
    test = d.where((F.col("split") == "test") & F.col("class").isNotNull())
    rows = test.select("doc_id", F.col("class").alias("label"))
    entries = feature_entries(test, fs)
    names = explain.names_table(spark, fs.names)
    imp = permutation.permutation_importance(rows, entries, coef, intercepts,
                                             names.select("feature_idx"),
                                             n_repeats=PERM_REPEATS, seed=SEED)
    named = imp.join(F.broadcast(names), "feature_idx")
    return explain.top_features(named.select("class", "feature_name", "importance"), TOP_N,
                                score_col="importance")


@query("forest_permutation")
def forest_permutation(spark, sf_dir):
    """Top 10 features per class by permutation importance (10 repeats) of the
    random forest; only predictions whose trees see a changed value are re-scored."""
    from ..operators import treeshap

    d, fs, rf = fitted_forest(spark, sf_dir)
    trees = treeshap.forest_trees(spark, rf, rf.numClasses)
    test = d.where((F.col("split") == "test") & F.col("label").isNotNull())
    rows = test.select("doc_id", F.col("label").cast("int").alias("label"))
    names = explain.names_table(spark, fs.names)
    imp = permutation.tree_permutation_importance(
        rows, feature_entries(test, fs), trees, names.select("feature_idx"), rf.numClasses,
        n_repeats=PERM_REPEATS, seed=SEED)
    codes = features.class_codes(d, "class")
    named = (imp.withColumnRenamed("class", "label")
                .join(F.broadcast(codes), "label")
                .join(F.broadcast(names), "feature_idx"))
    return explain.top_features(named.select("class", "feature_name", "importance"), TOP_N,
                                score_col="importance")


# ----------------------------------------------- boosted trees (one-vs-rest)

BOOST_ROUNDS = 500
BOOST_DEPTH = 6
BOOST_STEP = 0.3


def fitted_boosted(spark, sf_dir):
    """One binary GBT per class; the held-out split is the early-stopping set."""
    d, fs = prepared(spark, sf_dir)
    d = d.where(F.col("label").isNotNull()).withColumn("_is_val", F.col("split") == "test")
    classes = [int(r.label) for r in d.select("label").distinct().collect()]
    models = train.boosted_ovr(d, sorted(classes), max_iter=BOOST_ROUNDS, depth=BOOST_DEPTH,
                               step=BOOST_STEP, validation_col="_is_val", seed=SEED)
    return d, fs, models


@query("boosted_accuracy")
def boosted_accuracy(spark, sf_dir):
    d, _, models = fitted_boosted(spark, sf_dir)
    pred = train.ovr_predict(models, d.where(F.col("split") == "test"))
    return evaluate.accuracy(pred, "label", "prediction")


@query("boosted_history")
def boosted_history(spark, sf_dir):
    """(class, iteration, held-out log-loss) per boosting round of each binary model."""
    d, _, models = fitted_boosted(spark, sf_dir)
    rows = train.history(models, d.where(F.col("split") == "test"))
    return spark.createDataFrame(rows, "label int, iteration int, log_loss double")


@query("boosted_importance")
def boosted_importance(spark, sf_dir):
    """Top 10 features of each class's binary model by its own importance."""
    d, fs, models = fitted_boosted(spark, sf_dir)
    codes = {int(r.label): r["class"] for r in features.class_codes(d, "class").collect()}
    per_class = [explain.importance(spark, m, fs.names).withColumn("class", F.lit(codes[c]))
                 for c, m in sorted(models.items())]
    imp = per_class[0]
    for t in per_class[1:]:
        imp = imp.unionByName(t)
    return explain.top_features(imp, TOP_N, score_col="importance") \
        .select("class", "feature_name", "importance", "rank")


@query("boosted_permutation")
def boosted_permutation(spark, sf_dir):
    """E6 on the boosted one-vs-rest models (the reference's target model): top 10
    features per class by permutation importance (10 repeats) of the prediction."""
    from ..operators import treeshap

    d, fs, models = fitted_boosted(spark, sf_dir)
    n_classes = max(models) + 1
    trees = treeshap.one_vs_rest_trees(spark, models, n_classes)
    test = d.where((F.col("split") == "test") & F.col("label").isNotNull())
    rows = test.select("doc_id", F.col("label").cast("int").alias("label"))
    names = explain.names_table(spark, fs.names)
    imp = permutation.tree_permutation_importance(
        rows, feature_entries(test, fs), trees, names.select("feature_idx"), n_classes,
        n_repeats=PERM_REPEATS, seed=SEED)
    codes = features.class_codes(d, "class")
    named = (imp.withColumnRenamed("class", "label")
                .join(F.broadcast(codes), "label")
                .join(F.broadcast(names), "feature_idx"))
    return explain.top_features(named.select("class", "feature_name", "importance"), TOP_N,
                                score_col="importance")


# ----------------------------------------------- boosted trees on a bag of words (M3)

BOW_STEP = 0.1


def prepared_bow(spark, sf_dir):
    """Word/number tokens (X18), binary bag of words over the training
    vocabulary plus the two counts."""
    docs = read_table(spark, sf_dir, "documents", spread=True).select(
        "doc_id", F.col("lang").alias("class"), "text")
    docs = clean.clean_table(docs, "text", "tokens")
    docs = features.label_encode(docs, "class", "label")
    docs = docs.withColumn("tokens", F.split("clean_post", " "))
    docs = docs.withColumn("label", F.col("label").cast("double"))
    return feature_table(sample.hash_split(docs, "doc_id", 0.8, seed=SEED), train.bow_space)


@query("boosted_bow_accuracy")
def boosted_bow_accuracy(spark, sf_dir):
    """M3: one-vs-rest boosted trees (rate 0.1, depth 6, up to 500 rounds, early
    stopping on the held-out split) on the binary bag of words; accuracy."""
    d, _ = prepared_bow(spark, sf_dir)
    d = d.where(F.col("label").isNotNull()).withColumn("_is_val", F.col("split") == "test")
    classes = sorted(int(r.label) for r in d.select("label").distinct().collect())
    models = train.boosted_ovr(d, classes, max_iter=BOOST_ROUNDS, depth=BOOST_DEPTH,
                               step=BOW_STEP, validation_col="_is_val", seed=SEED)
    pred = train.ovr_predict(models, d.where(F.col("split") == "test"))
    return evaluate.accuracy(pred, "label", "prediction")


# ----------------------------------------------- TreeSHAP on the forest

def _forest_shap(spark, sf_dir):
    from ..operators import treeshap

    d, fs, rf = fitted_forest(spark, sf_dir)
    codes = features.class_codes(d, "class").select(F.col("label").cast("int").alias("label"),
                                                    "class")
    n_classes = rf.numClasses
    trees = treeshap.forest_trees(spark, rf, n_classes)
    test = d.where(F.col("split") == "test")
    phi = treeshap.tree_shap(test, "doc_id", "features", trees, len(fs.names))
    return d, fs, test, phi, codes, n_classes


@query("tree_attribution_top")
def tree_attribution_top(spark, sf_dir):
    """Mean |TreeSHAP| of the forest per class and feature, top 10 per class."""
    _, fs, test, phi, codes, _ = _forest_shap(spark, sf_dir)
    n_test = test.select(F.count(F.lit(1))).scalar()
    ma = explain.mean_abs_by_class(phi, n_test)
    named = (ma.join(F.broadcast(codes), "label")
               .join(F.broadcast(explain.names_table(spark, fs.names)), "feature_idx"))
    return explain.top_features(named.select("class", "feature_name", "mean_abs"), TOP_N)


@query("row_importance")
def row_importance(spark, sf_dir):
    """Per test row and feature: mean over classes of |TreeSHAP| (non-zero entries)."""
    _, fs, _, phi, _, n_classes = _forest_shap(spark, sf_dir)
    imp = explain.row_importance(phi, n_classes)
    return imp.join(F.broadcast(explain.names_table(spark, fs.names)), "feature_idx") \
              .select("doc_id", "feature_name", "importance")


# ----------------------------------------------- TreeSHAP on the boosted models

def _boosted_shap(spark, sf_dir):
    """Mean |TreeSHAP| of the boosted margins: (class, feature_name, score), with the class table."""
    from ..operators import treeshap

    d, fs, models = fitted_boosted(spark, sf_dir)
    codes = features.class_codes(d, "class")
    trees = treeshap.one_vs_rest_trees(spark, models, max(models) + 1)
    test = d.where(F.col("split") == "test")
    phi = treeshap.tree_shap(test, "doc_id", "features", trees, len(fs.names), average=False)
    n_test = test.select(F.count(F.lit(1))).scalar()
    ma = explain.mean_abs_by_class(phi, n_test)
    named = (ma.join(F.broadcast(codes), "label")
               .join(F.broadcast(explain.names_table(spark, fs.names)), "feature_idx"))
    return named.select("class", "feature_name", "mean_abs"), codes


@query("boosted_attribution_top")
def boosted_attribution_top(spark, sf_dir):
    """Mean |TreeSHAP| of the boosted margins per class and feature, top 10 per class."""
    scores, _ = _boosted_shap(spark, sf_dir)
    return explain.top_features(scores, TOP_N)


@query("boosted_biased_words")
def boosted_biased_words(spark, sf_dir):
    """Words biased toward a class by the boosted model's attributions (B2), ranked by relative
    gap within the class (T5)."""
    scores, codes = _boosted_shap(spark, sf_dir)
    scores = materialize(scores.select("class", F.col("feature_name").alias("term"),
                                       F.col("mean_abs").alias("score")))
    out = bias.biased_words(scores, codes.count(), mode="rel", threshold=REL_THRESHOLD)
    return bias.ranked(out).select("class", "term", "score", "max_other", "rel_diff", "rank")


@query("boosted_gain")
def boosted_gain(spark, sf_dir):
    """Top 10 features of each class's binary model by mean split gain."""
    return _per_class(spark, sf_dir, lambda nodes, names: explain.top_features(
        explain.gain_importance(nodes, names).withColumn("class", F.lit("")), TOP_N, score_col="gain")
        .drop("class").select("feature_name", "gain", "splits", "rank"))


@query("boosted_interactions")
def boosted_interactions(spark, sf_dir):
    """Split-gain interactions of each class's binary model."""
    return _per_class(spark, sf_dir, explain.interactions)


def _per_class(spark, sf_dir, fn):
    d, fs, models = fitted_boosted(spark, sf_dir)
    names = explain.names_table(spark, fs.names)
    out = None
    for r in features.class_codes(d, "class").orderBy("label").collect():  # the label set
        t = fn(explain.node_table(spark, models[int(r["label"])]), names).withColumn(
            "class", F.lit(r["class"]))
        out = t if out is None else out.unionByName(t)
    return out


@query("boosted_multiclass_history")
def boosted_multiclass_history(spark, sf_dir):
    """Multiclass held-out log-loss per boosting round, and the round that a patience of 50 keeps."""
    from ..operators import treeshap

    d, fs, models = fitted_boosted(spark, sf_dir)
    trees = treeshap.one_vs_rest_trees(spark, models, max(models) + 1)
    rounds = [i for _, m in sorted(models.items()) for i in range(m.getNumTrees)]
    losses = treeshap.boosted_losses(d.where(F.col("split") == "test"), "features", "label", trees,
                                     rounds, len(fs.names))
    rows = sorted((r["iteration"], r["log_loss"]) for r in losses.collect())  # a row per round
    kept = treeshap.stop_round([v for _, v in rows])
    return losses.withColumn("kept", F.col("iteration") == kept)


# ----------------------------------------------- boosted trees on the softmax loss (M2)

#: Rounds without a better held-out loss that end a fit; those that only need its trees wait less long.
PATIENCE = 50
SHORT_PATIENCE = 10


def fitted_softmax(spark, sf_dir, patience=SHORT_PATIENCE):
    """(rows, feature names, classes, trees by round, losses): the held-out split stops the fit."""
    d, fs = prepared(spark, sf_dir)
    d = d.where(F.col("label").isNotNull()).withColumn("_held_out", F.col("split") == "test")
    n = int(d.agg(F.max("label")).first()[0]) + 1
    trees, losses = softboost.fit(d, len(fs.names), n, held_out="_held_out", rounds=BOOST_ROUNDS, depth=BOOST_DEPTH,
                                  eta=BOOST_STEP, patience=patience)
    return d, fs.names, n, trees, losses


@query("softmax_accuracy")
def softmax_accuracy(spark, sf_dir):
    """M2, M4, M5: boosted trees on the softmax loss, argmax of the probabilities; held-out accuracy."""
    d, names, n, trees, _ = fitted_softmax(spark, sf_dir)
    pred = softboost.predict(d.where(F.col("split") == "test"), trees, len(names), n, ["doc_id", "label"])
    return evaluate.accuracy(pred, "label", "prediction")


@query("softmax_history")
def softmax_history(spark, sf_dir):
    """The held-out loss that the fit itself watches, a row a round, and the round it kept."""
    _, _, _, trees, losses = fitted_softmax(spark, sf_dir, PATIENCE)
    rows = [(k + 1, v, k + 1 == len(trees)) for k, v in enumerate(losses)]  # a row per round
    return spark.createDataFrame(rows, "iteration int, log_loss double, kept boolean")


@query("softmax_value_change")
def softmax_value_change(spark, sf_dir):
    """The ten features that change the softmax model's predictions most, as parts of 100."""
    _, names, _, trees, _ = fitted_softmax(spark, sf_dir)
    rows = [("all", k, v) for k, v in softboost.value_change(trees, names).items()]
    return explain.top_features(spark.createDataFrame(rows, "class string, feature_name string, importance double"),
                                TOP_N, score_col="importance")
