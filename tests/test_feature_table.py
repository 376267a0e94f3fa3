"""The feature table: tokens are made once, and odd token lists come back as they were."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.text import split_words
from corpuslens.operators import tfidf, train
from corpuslens.plans import model_q

ROWS = [(0, "a", "red fox  red"), (1, "b", ""), (2, "b", "blue fox"), (3, None, "red über blue"), (4, "a", None),
        (5, "a", "red")]


def clean(spark, tokens):
    d = spark.createDataFrame(ROWS, "doc_id long, class string, text string").coalesce(1)
    d = d.withColumn("tokens", tokens("text"))
    return d.withColumn("label", F.lit(1.0)).withColumn("split", F.lit("train")) \
            .withColumn("nr_of_words", F.lit(2)).withColumn("nr_of_characters", F.lit(3))


def test_tokens_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf(T.ArrayType(T.StringType()))
    def tokens(text):
        made.add(1)
        return (text or "").split()

    table, _ = model_q.feature_table(clean(spark, tokens), train.feature_space)
    assert table.count() == len(ROWS)
    assert made.value == len(ROWS)


def test_odd_token_lists(spark):
    def tokens(text):  # [""], [], a list with an empty token, and for no text an empty list
        return F.when(F.col("doc_id") == 5, F.array().cast("array<string>")).otherwise(
            F.split(F.coalesce(F.col(text), F.lit("")), " "))

    d = clean(spark, tokens)
    table, fs = model_q.feature_table(d, train.feature_space)
    model = tfidf.fit(d.where("split = 'train'"), "tokens", max_features=model_q.MAX_FEATURES)
    assert (fs.tfidf.terms, fs.tfidf.idfs) == (model.terms, model.idfs) and "" in model.terms
    want = {r.doc_id: r.features for r in train.feature_space(model).transform(d).collect()}
    got = {r.doc_id: r.features for r in table.collect()}
    assert got == want and table.columns == ["doc_id", "class", "label", "split", "features"]


def test_words_split_at_any_whitespace(spark):
    signs = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = ["", " ", "a", None, "  a  b ", "​x﻿y z", "a" + "".join(signs) + "b",
             *(f"{s}a{s}{s} b~!{s}" for s in signs), *(f"a{chr(c)}b" for c in range(1, 0x300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_words("t").alias("w"))
    for r in df.collect():
        assert r.w == (None if r.t is None else r.t.split()), repr(r.t)
