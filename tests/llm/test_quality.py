import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import quality as Q
from corpuslens.llm.common import WordHashes

from ..conftest import SF_CHECK
from .common import SCHEMA, hard, none, prose, row


def brute_grams(text, buckets):
    """Buckets of a text's n-grams, token by token."""
    from corpuslens.llm.common import mix

    h = [int(x) for x in WordHashes().of(Q._TOKEN.findall(text or ""))]
    marked = [int(Q._REPEAT) if (i and h[i - 1] == x) or (i > 1 and h[i - 2] == x) else x
              for i, x in enumerate(h)]
    one = [int(mix(np.array([x], np.uint64))[0]) % buckets for x in marked]
    two = [int(mix(np.array([(b * 31 + a) % 2 ** 64], np.uint64))[0]) % buckets
           for a, b in zip(marked, marked[1:])]
    return sorted(one + two)


def test_ngrams():
    texts = ["a b a, a. so so so", "", None, "one", "x !! y !! z !!", "one two"]
    g, begin = Q._ngrams(texts, WordHashes(), 97)
    for t, a, b in zip(texts, begin, begin[1:]):
        part = g[a:b]
        assert sorted(part[part >= 0].tolist()) == brute_grams(t, 97)


@pytest.mark.parametrize("k", [1, 2, 7, 50, 99, 100, 200])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=80) * 1e3, np.full(20, 3.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert Q.kth_largest(df, "v", k, digits=3) == np.sort(x)[::-1][min(k, len(x)) - 1]


def test_weights_and_draw(spark):
    docs = spark.createDataFrame([row(i, prose(30, i)) for i in range(40)]
                                 + [row(100 + i, "!! ## ".join(prose(30, i).split())) for i in range(20)],
                                 SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100, 0), (101, None), (999, 1), (None, 1)],
                                   "doc_id long, quality int")
    got = {r["doc_id"]: r for r in Q.resample(docs, labels, buckets=500).collect()}
    # The models, from the definition.
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    raw, target = np.zeros(500), np.zeros(500)
    for i, t in texts.items():
        np.add.at(raw, brute_grams(t, 500), 1)
        if i < 30:
            np.add.at(target, brute_grams(t, 500), 1)
    p = (raw + 1) / (raw.sum() + 500)
    ratio = np.log((target + 0.05 * target.sum() * p) / (1.05 * target.sum())) - np.log(p)
    for i, t in texts.items():
        g = brute_grams(t, 500)
        want = ratio[g].sum() * Q.COUNTS_AS / (len(g) + Q.PRIOR)
        assert got[i]["log_weight"] == pytest.approx(want) and got[i]["n_grams"] == len(g)
    assert all(got[i]["kept"] == (i < 100) for i in got)
    # Top-k by key, k given.
    some = Q.resample(docs, labels, buckets=500, k=7, keep=["doc_id"]).collect()
    keys = sorted((r["gumbel_key"] for r in some), reverse=True)
    assert sum(r["kept"] for r in some) == 7
    assert all(r["kept"] == (r["gumbel_key"] >= keys[6]) for r in some)
    other = Q.resample(docs, labels, buckets=500, k=7, seed=1, keep=["doc_id"]).collect()
    assert {r["doc_id"] for r in other if r["kept"]} != {r["doc_id"] for r in some if r["kept"]}


def test_gumbel_top_k_draws_in_proportion():
    """Keys of weight w win against keys of weight 1 as often as w to 1."""
    from corpuslens.llm.common import mix

    u = mix(np.arange(200_000, dtype=np.uint64))
    u = ((u >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53
    g = -np.log(-np.log(u))
    assert abs((g[::2] + np.log(3) > g[1::2]).mean() - 0.75) < 0.01


def test_labels_of_the_table(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    got = Q.resample(docs.select("doc_id", "text"), labels, keep=["doc_id"]).join(labels, "doc_id")
    c = {(r["quality"], r["kept"]): r["n"] for r in
         got.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert c.get((1, True), 0) >= 0.95 * (c.get((1, True), 0) + c.get((1, False), 0))
    assert c.get((0, False), 0) >= 0.95 * (c.get((0, True), 0) + c.get((0, False), 0))


def test_hard_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (5, 0)], "doc_id long, quality int")
    got = Q.resample(hard(spark), labels)
    assert got.columns == [*hard(spark).columns, "n_grams", "log_weight", "gumbel_key", "kept"]
    rows = got.collect()
    assert len(rows) == hard(spark).count()
    for r in rows:
        if not (r["text"] or "").strip():
            assert r["log_weight"] == 0.0
    same = [r for r in rows if r["doc_id"] == 2]
    assert same[0]["gumbel_key"] == same[1]["gumbel_key"]
    nothing = labels.where("false")
    assert all(r["kept"] and r["log_weight"] == 0 for r in Q.resample(hard(spark), nothing).collect())
    assert Q.resample(none(spark), labels).collect() == []
