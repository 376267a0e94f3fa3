import math

from corpuslens.operators import bias, tfidf


def _scores(spark, rows):
    return spark.createDataFrame(rows, "class string, term string, score double")


def test_abs_threshold_edges(spark):
    rows = [("a", "only_a", 1.2),
            ("a", "gap_exact", 2.0), ("b", "gap_exact", 1.5), ("c", "gap_exact", 1.0),
            ("a", "gap_more", 2.0000001), ("b", "gap_more", 1.5), ("c", "gap_more", 1.5)]
    got = {(r["class"], r.term) for r in bias.biased_words(_scores(spark, rows), 3, "abs", 0.5).collect()}
    assert got == {("a", "only_a"), ("a", "gap_more")}


def test_relative_edges(spark):
    rows = []
    for term, vals in {"t0": (0, 0, 0), "t1": (1, 0, 0), "t2": (2, 1, 1), "t3": (2.1, 1, 1)}.items():
        rows += [(c, term, float(v)) for c, v in zip("abc", vals)]
    out = bias.biased_words(_scores(spark, rows), 3, "rel", 1.0).collect()
    got = {(r["class"], r.term): r.rel_diff for r in out}
    assert set(got) == {("a", "t1"), ("a", "t3")}
    assert math.isinf(got[("a", "t1")]) and abs(got[("a", "t3")] - 1.1) < 1e-12


def test_max_other_absent_classes_count_as_zero(spark):
    rows = [("a", "x", -1.0), ("b", "x", -2.0)]
    got = {r["class"]: r.max_other for r in bias.max_other(_scores(spark, rows), 3).collect()}
    assert got == {"a": 0.0, "b": 0.0}
    got2 = {r["class"]: r.max_other for r in bias.max_other(_scores(spark, rows), 2).collect()}
    assert got2 == {"a": -2.0, "b": -1.0}


def test_compare_terms_absent_is_null(spark):
    g = spark.createDataFrame([("x", 1.5)], "term string, idf double")
    c = spark.createDataFrame([("a", "x", 1.2)], "class string, term string, idf double")
    terms = spark.createDataFrame([("x",), ("zzzz",)], "term string")
    got = {r.term: r for r in bias.compare_terms(g, c, terms, ["a", "b"]).collect()}
    assert got["zzzz"].global_score is None and got["zzzz"].score_a is None
    assert got["x"].global_score == 1.5 and got["x"].score_a == 1.2 and got["x"].score_b is None


def test_idf_matches_brute_force(spark):
    import re
    from collections import Counter

    docs = [(1, "a", "the cat the cat sat"), (2, "a", "the dog"), (3, "b", "cat cat cat x"),
            (4, "b", "dog sat on the mat"), (5, "a", "")]
    df = spark.createDataFrame(docs, "doc_id long, class string, text string")
    df = df.withColumn("tokens", tfidf.vector_terms("text"))
    got = {(r["class"], r.term): (r.df, r.tf, r.idf)
           for r in tfidf.idf_by(df, "tokens", "class", min_df=1, max_features=2).collect()}
    exp = {}
    for cls in ("a", "b"):
        texts = [t for _, c, t in docs if c == cls]
        toks = [re.findall(r"(?u)\b\w\w+\b", t.lower()) for t in texts]
        dfc = Counter(t for ts in toks for t in set(ts))
        tfc = Counter(t for ts in toks for t in ts)
        keep = sorted(dfc, key=lambda t: (-tfc[t], t))[:2]
        for t in keep:
            exp[(cls, t)] = (dfc[t], tfc[t], math.log((1 + len(texts)) / (1 + dfc[t])) + 1)
    assert set(got) == set(exp)
    for k in exp:
        assert got[k][:2] == exp[k][:2] and abs(got[k][2] - exp[k][2]) < 1e-12


def test_class_smaller_than_min_df_is_empty_not_error(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", ["x"]), (3, "b", ["z"])],
                               "doc_id long, class string, tokens array<string>")
    assert tfidf.idf_by(df, "tokens", "class", min_df=5).count() == 0
