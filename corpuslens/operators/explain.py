"""Model explanation as DataFrames.

* ``importance``: the model's own impurity importances joined to names (E1);
* ``node_table`` / ``gain_importance`` / ``interactions``: the saved tree
  nodes read back as a table; mean split gain per feature (E2), and summed
  child gain per unordered (parent feature, child feature) pair (E4);
* ``linear_mean_abs``: exact attributions of a linear model,
  phi = w * (x - mean(x)), aggregated to mean |phi| per (class, feature) from
  the non-zero entries only: rows where x = 0 contribute |w * mean| each (A12);
* ``presence_weights`` / ``presence_mean_abs``: the same for a closed-form
  linear model over term presence (class log-odds), computable in SQL;
* ``top_features``: top-k per class (T3/T4), skew-safe.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .topk import top_k


def _check_width(n_features: int, names: list[str]) -> None:
    """The attribution width must equal the feature count; never skip silently."""
    if n_features != len(names):
        raise ValueError(f"model has {n_features} features but {len(names)} names")


def names_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "feature_idx int, feature_name string")


def importance(spark: SparkSession, model, names: list[str]) -> DataFrame:
    """(feature_idx, feature_name, importance) from ``featureImportances``."""
    imp = model.featureImportances
    _check_width(imp.size, names)
    rows = [(i, names[i], float(imp[i])) for i in range(imp.size)]
    return spark.createDataFrame(rows, "feature_idx int, feature_name string, importance double")


def saved_tree_data(spark: SparkSession, model) -> DataFrame:
    """The raw node rows (treeID, nodeData) of a tree-ensemble model, saved under
    the session's shared checkpoint folder and read back as a table."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/models/{uuid.uuid4().hex}"
    model.write().overwrite().save(base)
    return spark.read.parquet(base + "/data")


def node_table(spark: SparkSession, model) -> DataFrame:
    """Tree nodes: (tree_id, node_id, feature_idx, gain, left, right, count, prediction)."""
    data = saved_tree_data(spark, model)
    return data.select(
        F.col("treeID").alias("tree_id"), F.col("nodeData.id").alias("node_id"),
        F.col("nodeData.split.featureIndex").alias("feature_idx"),
        F.col("nodeData.gain").alias("gain"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.rawCount").alias("count"),
        F.col("nodeData.prediction").alias("prediction"))


def gain_importance(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(feature_idx, feature_name, gain, splits): mean gain over the splits on a feature."""
    splits = nodes.where(F.col("left") >= 0)
    g = splits.groupBy("feature_idx").agg(F.avg("gain").alias("gain"),
                                          F.count(F.lit(1)).alias("splits"))
    return g.join(F.broadcast(names), "feature_idx", "left")


def interactions(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(feature_a, feature_b, score): child split gain summed over parent/child pairs
    splitting on two different features, per unordered pair (our own definition)."""
    splits = nodes.where(F.col("left") >= 0)
    parent = splits.select("tree_id", F.col("feature_idx").alias("pf"),
                           F.explode(F.array("left", "right")).alias("node_id"))
    child = splits.select("tree_id", "node_id", F.col("feature_idx").alias("cf"), "gain")
    pairs = (parent.join(child, ["tree_id", "node_id"])
                   .where(F.col("pf") != F.col("cf"))
                   .select(F.least("pf", "cf").alias("a"), F.greatest("pf", "cf").alias("b"),
                           "gain"))
    agg = pairs.groupBy("a", "b").agg(F.sum("gain").alias("score"))
    na = F.broadcast(names.select(F.col("feature_idx").alias("a"),
                                  F.col("feature_name").alias("feature_a")))
    nb = F.broadcast(names.select(F.col("feature_idx").alias("b"),
                                  F.col("feature_name").alias("feature_b")))
    return agg.join(na, "a").join(nb, "b").select("feature_a", "feature_b", "score")


def linear_mean_abs(entries: DataFrame, coef: DataFrame, n_rows,
                    id_col: str = "doc_id") -> DataFrame:
    """Mean |w * (x - mean)| per (class, feature_idx) over ``n_rows`` explained rows.

    ``entries``: (id, feature_idx, value) for non-zero feature values.
    ``coef``: (class, feature_idx, w), bounded by classes x features.
    """
    n = n_rows if not isinstance(n_rows, int) else F.lit(n_rows)
    stats = entries.groupBy("feature_idx").agg(F.sum("value").alias("_sum"),
                                               F.count(F.lit(1)).alias("_nnz"))
    stats = stats.withColumn("_mean", F.col("_sum") / n)
    # Coefficients are model parameters (classes x features): safe to broadcast.
    j = entries.join(F.broadcast(coef), "feature_idx")
    j = j.join(F.broadcast(stats.select("feature_idx", "_mean")), "feature_idx")
    s = j.groupBy("class", "feature_idx").agg(
        F.sum(F.abs(F.col("w") * (F.col("value") - F.col("_mean")))).alias("_s"))
    full = (coef.join(stats, "feature_idx", "left")
                .join(s, ["class", "feature_idx"], "left")
                .na.fill(0, ["_s", "_nnz", "_mean"]))
    zeros = (n - F.col("_nnz")) * F.abs(F.col("w") * F.col("_mean"))
    return full.select("class", "feature_idx", ((F.col("_s") + zeros) / n).alias("mean_abs"))


def coefficient_table(spark: SparkSession, lr_model, class_names: list | None = None) -> DataFrame:
    """(class, feature_idx, w) from a (multinomial) logistic regression model."""
    m = lr_model.coefficientMatrix.toArray()
    rows = []
    for c in range(m.shape[0]):
        cname = class_names[c] if class_names else c
        for j in range(m.shape[1]):
            if m[c, j] != 0.0:
                rows.append((str(cname), j, float(m[c, j])))
    return spark.createDataFrame(rows, "class string, feature_idx int, w double")


def presence_weights(presence: DataFrame, class_sizes: DataFrame, class_col: str,
                     classes: list[str], term_col: str = "term",
                     smoothing: float = 1.0) -> DataFrame:
    """Class log-odds weights over term presence (class, term, w):
    w = ln((df_c + a) / (n_c + 2a)) - ln((df_rest + a) / (n_rest + 2a)).

    ``presence``: distinct (id, class, term) rows of the training documents;
    ``class_sizes``: (class, n_c) training documents per class;
    ``classes``: the label set. The result is the dense weight matrix of the
    model (classes x vocabulary, both bounded), so each term row is expanded
    over the class list.
    """
    a = F.lit(smoothing)
    df_ct = presence.groupBy(class_col, term_col).agg(F.count(F.lit(1)).alias("df_c"))
    df_t = presence.groupBy(term_col).agg(F.count(F.lit(1)).alias("df_all"))
    n_c = class_sizes.select(class_col, "n_c")
    n_all = n_c.select(F.sum("n_c")).scalar()
    per_class = df_t.withColumn(class_col, F.explode(F.array(*[F.lit(c) for c in classes])))
    full = (per_class.join(df_ct, [class_col, term_col], "left").na.fill(0, ["df_c"])
                     .join(F.broadcast(n_c), class_col, "left").na.fill(0, ["n_c"]))
    rest_df = F.col("df_all") - F.col("df_c")
    rest_n = n_all - F.col("n_c")
    w = (F.log((F.col("df_c") + a) / (F.col("n_c") + 2 * a))
         - F.log((rest_df + a) / (rest_n + 2 * a)))
    return full.select(class_col, term_col, w.alias("w"))


def top_features(scores: DataFrame, k: int = 10, class_col: str = "class",
                 feature_col: str = "feature_name", score_col: str = "mean_abs") -> DataFrame:
    return top_k(scores, [class_col], [F.col(score_col).desc(), F.col(feature_col).asc()], k,
                 rank_col="rank", salt_on=[feature_col])


def presence_mean_abs(weights: DataFrame, test_presence: DataFrame, n_rows,
                      term_col: str = "term", class_col: str = "class") -> DataFrame:
    """Mean |phi| per (class, term) for the presence model over ``n_rows`` rows:
    phi = w * (x - m) with x in {0, 1} and m = nnz / n, so the mean is
    (nnz * |w (1 - m)| + (n - nnz) * |w m|) / n, from document counts alone."""
    nnz = test_presence.groupBy(term_col).agg(F.count(F.lit(1)).alias("_nnz"))
    j = weights.join(nnz, term_col, "left").na.fill(0, ["_nnz"])
    n = n_rows
    m = F.col("_nnz") / n
    val = (F.col("_nnz") * F.abs(F.col("w") * (1 - m)) + (n - F.col("_nnz")) * F.abs(F.col("w") * m)) / n
    return j.select(class_col, term_col, val.alias("mean_abs"))


def row_importance(phi: DataFrame, n_classes, id_col: str = "doc_id") -> DataFrame:
    """Mean over classes of |phi| per (row, feature); absent entries are 0."""
    return (phi.groupBy(id_col, "feature_idx")
               .agg((F.sum(F.abs("phi")) / F.lit(n_classes)).alias("importance")))


def mean_abs_by_class(phi: DataFrame, n_rows) -> DataFrame:
    """Mean |phi| per (label, feature) over ``n_rows`` rows; absent entries are 0."""
    return phi.groupBy("label", "feature_idx").agg((F.sum(F.abs("phi")) / n_rows).alias("mean_abs"))
