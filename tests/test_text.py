from collections import Counter

from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.contractions import with_expanded_contractions


def test_bag_of_words_counts(spark):
    rows = [(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["x"]), (4, None)]
    df = spark.createDataFrame(rows, "id long, toks array<string>")
    out = {r.id: r.bag for r in T.with_bag(df, "toks", "bag", keep=["id"]).collect()}
    assert [(x.term, x.tf) for x in out[1]] == sorted(Counter(rows[0][1]).items())
    assert out[2] == [] and [(x.term, x.tf) for x in out[3]] == [("x", 1)]


def test_bag_matches_counter_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    toks = docs.select("doc_id", T.vector_terms("text").alias("t"))
    bags = {r.doc_id: {x.term: x.tf for x in r.bag}
            for r in T.with_bag(toks, "t", "bag", keep=["doc_id"]).collect()}
    for r in toks.collect():
        assert bags[r.doc_id] == dict(Counter(r.t))


def test_char_ngrams(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("é€x y",), (None,)], "s string")
    got = [r.g for r in df.select(T.char_ngrams("s", 3).alias("g")).collect()]
    assert got[0] == ["abc", "bcd"] and got[1] == []
    assert got[2] == ["é€x", "€x ", "x y"] and got[3] == []


def test_word_and_char_counts(spark):
    texts = ["a  b\tc", "", "  \t", None, "x y\u001cz"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select(T.word_count("s").alias("w"), T.char_count("s").alias("c")).collect()
    for t, r in zip(texts, got):
        assert r.w == (len(t.split()) if t else 0)
        assert r.c == (len(t) if t else 0)


def test_vector_terms_match_python(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("text", T.vector_terms("text").alias("t")).collect()
    for r in rows:
        assert r.t == re.findall(r"(?u)\b\w\w+\b", r.text.lower())


def test_contractions(spark):
    df = spark.createDataFrame([("don't stop",), ("it's they'll go",), ("no apostrophe",)], "s string")
    got = [r.e for r in with_expanded_contractions(df, "s", "e").collect()]
    assert got == ["do not stop", "it is they will go", "no apostrophe"]


def test_contractions_by_token(spark):
    texts = ["don't don't", "y'all've don’t", "l'homme it's", "'tis 'don't' x", "can't-won't", None, "she'llx"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.e for r in with_expanded_contractions(df, "s", "e").collect()]
    assert got == ["do not do not", "you all've do not", "l'homme it is", "'tis 'do not' x",
                   "cannot-will not", None, "she'llx"]


def test_remove_words_keeps_order_and_duplicates(spark):
    df = spark.createDataFrame([(["a", "the", "b", "a", "the"],)], "t array<string>")
    assert df.select(T.remove_words("t", ["the"]).alias("x")).collect()[0].x == ["a", "b", "a"]


def test_user_functions_null_guard_and_batches(spark):
    from corpuslens.functions.user import map_column, map_partitions

    df = spark.createDataFrame([(1, "a  b\tc"), (2, None), (3, "")], "id long, s string")
    calls = map_column(df, "s", lambda t: len(t.split()), "n", "bigint")
    got = {r.id: r.n for r in calls.collect()}
    assert got == {1: 3, 2: None, 3: 0}

    def upper(pdf):
        return pdf.assign(s=pdf["s"].str.upper())

    out = {r.id: r.s for r in map_partitions(df.repartition(3), upper, "id long, s string").collect()}
    assert out == {1: "A  B\tC", 2: None, 3: ""}


def test_user_function_never_sees_null_numbers(spark):
    from corpuslens.functions.user import map_column

    seen = spark.createDataFrame([(1,), (None,), (3,)], "v long").union(
        spark.createDataFrame([(None,), (5,)], "v long"))

    def add_one(v):
        assert v == v and v is not None
        return int(v) + 1

    got = sorted((r.v, r.o) for r in map_column(seen, "v", add_one, "o", "bigint").collect() if r.v)
    assert got == [(1, 2), (3, 4), (5, 6)]
    assert map_column(seen, "v", add_one, "o", "bigint").where("v IS NULL AND o IS NULL").count() == 2
