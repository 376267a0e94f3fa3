import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import markup as M

CRAFTED = [
    "a **b** __c__ *d* _e_ ***f*** ___g___",
    "~~x~~ >!sp!< ^(up) ^sup `c`",
    "see r/politics and u/bob either/or",
    "[t](http://a.b) [t][1] [1]: http://x",
    "## Head\n- item\n* it2\n1. one\n - nb\r\n# cr\rx",
    "<a b> > quoted &gt; &lt; &nbsp; &amp;",
    "sooooo 1 12 123 1234 12345 ww2 3d",
    "tail\n",
    "٣. arabic ١٢٣",
    "café 12é \u001c x # y",
    "#\n\n  next",
    "a__b__c_d_",
    "[[a](b) [x[y](z) [[[q]][r]",
    "12. 3.\n 45.x 6. 7 in 2016. The",
    "2000 2016",
    "",
]
HOSTILE = ["[" * 15000, "<" * 15000, "1" * 15000, "\n" * 15000, "[a" * 7500, "-\n" * 7500]
# Rows on which the plain patterns take quadratic time although the guards let them through.
QUADRATIC = [lambda n: "^(" * n, lambda n: "[a](" * n, lambda n: "> " + "<" * n,
             lambda n: "[a" * n + "](b", lambda n: "\n" * n + "a- b", lambda n: "[a][" * n,
             lambda n: "<" * n + "_>", lambda n: ">!a" * n, lambda n: "^(" * n + ")"]


def _spark_apply(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    out = M.with_stripped_markup(df, "t", "c", **kw).select("id", "c").collect()
    return {r.id: r.c for r in out}


def test_each_rule_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CRAFTED)], "id long, t string")
    for i, pat, rep in M.java_rules():
        got = {r.id: r.c for r in df.select("id", F.regexp_replace("t", pat, rep).alias("c")).collect()}
        py_pat, py_rep, _ = M.MARKUP_RULES[i]
        for j, t in enumerate(CRAFTED):
            assert got[j] == re.sub(py_pat, py_rep, t, flags=re.MULTILINE), (i, t)


def test_chain_matches_python(spark):
    got = _spark_apply(spark, CRAFTED)
    for i, t in enumerate(CRAFTED):
        assert got[i] == M.python_reference(t), t


def test_chain_matches_python_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    texts = [r[0] for r in docs] + [r[0] for r in pages]
    got = _spark_apply(spark, texts)
    assert all(got[i] == M.python_reference(t) for i, t in enumerate(texts))


def test_year_squeeze_case(spark):
    got = _spark_apply(spark, ["2000", "2016"])
    assert got[0] == "" and got[1] == "2016"


def test_null_stays_null(spark):
    df = spark.createDataFrame([(1, None)], "id long, t string")
    assert M.with_stripped_markup(df, "t", "c").collect()[0].c is None


@pytest.mark.parametrize("h", HOSTILE, ids=lambda h: repr(h[:2]))
def test_hostile_rows_are_fast_and_exact(spark, h):
    t0 = time.time()
    got = _spark_apply(spark, [h])[0]
    assert time.time() - t0 < 20
    assert got == M.python_reference(h)


def test_linear_rules_equal_python_on_random_rows(spark):
    r = random.Random(9)
    parts = ["[", "]", "(", ")", "<", ">", "_", "^", "*", "-", "\n", " ", "a", "1.", "!", "^(", "](", "][",
             "> ", "#", "`", "~~", "__", "\t", "\r\n", "r/", "12"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 18))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rules = M.java_rules()
    for row in df.select("id", *[F.regexp_replace("t", p, q).alias(f"r{i}") for i, p, q in rules]).collect():
        for i, _, _ in rules:
            p, q, _ = M.MARKUP_RULES[i]
            assert row[f"r{i}"] == re.sub(p, q, texts[row["id"]], flags=re.M), (i, texts[row["id"]])


@pytest.mark.parametrize("k", range(len(QUADRATIC)))
def test_hostile_rows_take_linear_time(spark, k):
    def seconds(n):
        df = spark.createDataFrame([(QUADRATIC[k](n),)], "t string")
        out = M.with_stripped_markup(df, "t", "c").select("c")
        out.collect()
        best = []
        for _ in range(3):
            began = time.time()
            out.collect()
            best.append(time.time() - began)
        return min(best)

    assert seconds(80_000) < 2 * seconds(40_000) + 0.5


def test_duckdb_chain_equals_spark_on_documents(spark):
    import duckdb

    con = duckdb.connect()
    rows = con.execute(
        f"SELECT doc_id, {M.duckdb_expr('text')} FROM "
        "read_parquet('/root/testdata/sf0.001/documents.parquet')").fetchall()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.c for r in M.with_stripped_markup(texts, "text", "c", skip=(M.SQUEEZE_RULE,))
           .select("doc_id", "c").collect()}
    assert all(got[i] == c for i, c in rows)


def test_groups_of_rules_are_skipped_without_their_signs(spark):
    """A text that lacks a rule's signs meets no regex of it, and the results stay Python's."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab 1234.*_~>!^`ru/[]():#-<&gtl;é٣\n") for _ in range(40)) for _ in range(300)]
    texts += ["plain text 12 345", "", "1. a 22. b", "x12 12x 123 1234 12345 1_2 a.1. b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    out = M.with_stripped_markup(df, "t", "o", skip=(M.SQUEEZE_RULE,))
    for r in out.collect():
        assert r.o == M.python_reference(texts[r.id], skip=(M.SQUEEZE_RULE,)), texts[r.id]
    free = [i for i in range(len(M.MARKUP_RULES)) if not M._REQUIRES.get(i)]
    assert free == [18, M.SQUEEZE_RULE, 27]
    # The quick form of the last rule is for ASCII: the general one stands in when nothing makes it so.
    assert dict((i, p) for i, p, _ in M.java_rules(skip=(21,)))[27] == "(?mdU)" + M.MARKUP_RULES[27][0]


def test_full_cleaner_splits_its_words_once(spark):
    from corpuslens.operators import clean

    texts = ["a  - b\tc", "", None, " The  dog's *big* house. 12 345\n\x1cx", "..", "é z　y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = clean.clean_table(df, "text", "full")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    for r in out.collect():
        if texts[r.id] is None:
            assert r.clean_post is None and r.nr_of_words == r.nr_of_characters == 0
        else:
            assert r.clean_post == " ".join(r.clean_post.split())
            assert (r.nr_of_words, r.nr_of_characters) == (len(r.clean_post.split()), len(r.clean_post))
