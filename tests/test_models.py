"""Model queries at sf0.001: run, sane values, TreeSHAP additivity, L2 == L1."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from corpuslens.operators import treeshap
from corpuslens.plans import model_q

from .conftest import SF_SMALL


def test_forest_and_attributions(spark):
    acc = E.queries()["forest_accuracy"](spark, SF_SMALL).collect()[0]
    assert acc.n > 0 and acc.accuracy > 0.7
    d, fs, rf = model_q.fitted_forest(spark, SF_SMALL)
    trees = treeshap.forest_trees(spark, rf, rf.numClasses)
    test = d.where(F.col("split") == "test").limit(5)
    phi = treeshap.tree_shap(test, "doc_id", "features", trees, len(fs.names)).toPandas()
    probs = {r.doc_id: np.array(r.probability.toArray()) for r in rf.transform(test).collect()}
    base = sum(treeshap.expected_value(t) for t in trees) / len(trees)
    for doc_id, p in probs.items():
        rows = phi[phi.doc_id == doc_id]
        total = np.array([rows[rows.label == c].phi.sum() for c in range(rf.numClasses)])
        assert np.allclose(total + base, p, atol=1e-9)


def test_batch_model_keeps_null(spark):
    from corpuslens.operators import lang

    df = spark.createDataFrame([(1, "the cat"), (2, None)], "id long, text string")
    got = {r.id: r.language for r in lang.detect_with(df, "text", lambda: (lambda ts: ["x"] * len(ts))).collect()}
    assert got == {1: "x", 2: None}


def test_language_by_bags_equals_by_occurrences(spark, monkeypatch):
    from corpuslens.operators import lang

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang", "text")
    profile, priors = lang.fit_profiles(docs, "doc_id", "text", "lang")
    a = {r.doc_id: (r.predicted, round(r.score, 6)) for r in
         lang.detect(docs, "doc_id", "text", profile, priors).collect()}
    monkeypatch.setattr(lang, "BROADCAST_MAX_BYTES", 0)
    b = {r.doc_id: (r.predicted, round(r.score, 6)) for r in
         lang.detect(docs, "doc_id", "text", profile, priors).collect()}
    assert a == b


def test_boosted_runs(spark):
    acc = E.queries()["boosted_accuracy"](spark, SF_SMALL).collect()[0]
    assert acc.accuracy > 0.7


def test_boosted_importance_per_class(spark):
    rows = E.queries()["boosted_importance"](spark, SF_SMALL).collect()
    by_class = {}
    for r in rows:
        by_class.setdefault(r["class"], []).append(r)
    assert len(by_class) >= 2
    for rs in by_class.values():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1))
        assert all(a.importance >= b.importance for a, b in zip(rs, rs[1:]))
        # each binary model's importances sum to 1, so its top 10 sum to at most 1
        assert sum(r.importance for r in rs) <= 1 + 1e-9


def test_boosted_bag_of_words(spark):
    d, fs = model_q.prepared_bow(spark, SF_SMALL)
    v = d.select("features").first().features
    assert v.size == len(fs.names)
    # binary presence for the terms, raw counts for the two numerics
    assert set(v.values[v.indices < fs.tfidf.size]) <= {1.0}
    acc = E.queries()["boosted_bow_accuracy"](spark, SF_SMALL).collect()[0]
    assert acc.accuracy > 0.7


def test_one_vs_rest_trees_reproduce_predictions(spark):
    from corpuslens.operators import train

    d, fs, models = model_q.fitted_boosted(spark, SF_SMALL)
    n_classes = max(models) + 1
    trees = treeshap.one_vs_rest_trees(spark, models, n_classes)
    test = d.where(F.col("split") == "test")
    pred = {r.doc_id: int(r.prediction) for r in train.ovr_predict(models, test).collect()}
    for r in test.select("doc_id", "features").collect():
        margins = sum(t.value[_leaf(t, r.features.toArray())] for t in trees)
        assert int(np.argmax(margins)) == pred[r.doc_id]


def _leaf(t, x):
    j = 0
    while t.left[j] >= 0:
        j = t.left[j] if x[t.feature[j]] <= t.threshold[j] else t.right[j]
    return j


def test_boosted_attributions(spark):
    """TreeSHAP of the boosted margins adds up to them; the history's last round is the model."""
    from corpuslens.operators import explain, train

    d, fs, models = model_q.fitted_boosted(spark, SF_SMALL)
    n = max(models) + 1
    trees = treeshap.one_vs_rest_trees(spark, models, n)
    test = d.where(F.col("split") == "test")
    phi = treeshap.tree_shap(test, "doc_id", "features", trees, len(fs.names), average=False).toPandas()
    base = sum(treeshap.expected_value(t) for t in trees)
    rows = test.select("doc_id", "label", "features").collect()
    x = np.array([r.features.toArray() for r in rows])
    margin = treeshap.margins(trees, x).sum(0)
    for r, m in zip(rows, margin):
        own = phi[phi.doc_id == r.doc_id]
        total = np.array([own[own.label == c].phi.sum() for c in range(n)])
        assert np.allclose(total + base, m, atol=1e-8)
    # A12 and A13 against the long table.
    ma = {(r.label, r.feature_idx): r.mean_abs for r in explain.mean_abs_by_class(
        spark.createDataFrame(phi), F.lit(float(len(rows)))).collect()}
    for (c, f), g in phi.groupby(["label", "feature_idx"]):
        assert np.isclose(ma[c, f], g.phi.abs().sum() / len(rows))
    ri = {(r.doc_id, r.feature_idx): r.importance for r in
          explain.row_importance(spark.createDataFrame(phi), n).collect()}
    for (i, f), g in phi.groupby(["doc_id", "feature_idx"]):
        assert np.isclose(ri[i, f], g.phi.abs().sum() / n)
    # Multiclass loss.
    rounds = [i for _, m in sorted(models.items()) for i in range(m.getNumTrees)]
    loss = {r.iteration: (r.log_loss, r.n) for r in treeshap.boosted_losses(
        test, "features", "label", trees, rounds, len(fs.names)).collect()}
    p = 1 / (1 + np.exp(-2 * margin))
    p /= p.sum(1, keepdims=True)
    y = np.array([int(r.label) for r in rows])
    want = -np.log(np.clip(p[np.arange(len(y)), y], 1e-15, 1)).mean()
    assert np.isclose(loss[max(loss)][0], want) and loss[1][1] == len(rows)
    binary = train.history(models, test)
    assert {c for c, _, _ in binary} == set(models) and all(v >= 0 for _, _, v in binary)
    # E2 and E4 against the nodes, one by one.
    nodes = explain.node_table(spark, models[0])
    names = explain.names_table(spark, fs.names)
    table = {(r.tree_id, r.node_id): r for r in nodes.collect()}
    gains, pairs = {}, {}
    for (t, _), r in table.items():
        if r.left >= 0:
            gains.setdefault(r.feature_idx, []).append(r.gain)
            for child in (table[t, r.left], table[t, r.right]):
                if child.left >= 0 and child.feature_idx != r.feature_idx:
                    key = tuple(sorted((r.feature_idx, child.feature_idx)))
                    pairs[key] = pairs.get(key, 0.0) + child.gain
    got = {r.feature_idx: (r.gain, r.splits) for r in explain.gain_importance(nodes, names).collect()}
    assert got.keys() == gains.keys()
    assert all(np.isclose(got[f][0], np.mean(g)) and got[f][1] == len(g) for f, g in gains.items())
    inter = {tuple(sorted((fs.names.index(r.feature_a), fs.names.index(r.feature_b)))): r.score
             for r in explain.interactions(nodes, names).collect()}
    assert inter.keys() == pairs.keys() and all(np.isclose(inter[k], v) for k, v in pairs.items())


def test_width_mismatch_raises(spark):
    import pytest

    from corpuslens.operators import evaluate, explain

    d, fs, rf = model_q.fitted_forest(spark, SF_SMALL)
    with pytest.raises(ValueError):
        explain.importance(spark, rf, fs.names[:-1])
    assert explain.importance(spark, rf, fs.names).agg(F.sum("importance")).first()[0] > 0.99
    from pyspark.ml.functions import vector_to_array

    pred = rf.transform(d).select("prediction", evaluate.argmax(vector_to_array("probability")).alias("a"))
    assert pred.where("prediction <> a").count() == 0
