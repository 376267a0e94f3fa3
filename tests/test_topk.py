"""Top-k by counts and ranked biased words against plain Python."""

import random

from corpuslens.operators import bias
from corpuslens.operators.topk import top_counts


def test_top_counts_equals_sorting(spark):
    r = random.Random(1)
    rows = [(g, f"t{i:04d}", r.randint(1, 6) if g != "z" else 1) for g in "xyz" for i in range(400)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "class string, term string, tf long").repartition(5)
    for k in (1, 7, 60, 399, 400, 1000):
        got = {(x["class"], x["term"]) for x in top_counts(df, "class", "tf", "term", k).collect()}
        want = {(g, t) for c in "xyz" for g, t, _ in
                sorted((x for x in rows if x[0] == c), key=lambda x: (-x[2], x[1]))[:k]}
        assert got == want, k
    assert top_counts(df.where("false"), "class", "tf", "term", 3).collect() == []


def test_ranked(spark):
    r = random.Random(2)
    rows = [(c, f"t{i}", float("inf") if r.random() < 0.1 else round(r.random(), 1)) for c in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "class string, term string, rel_diff double").repartition(4)
    got = {(x["class"], x["term"]): x["rank"] for x in bias.ranked(df).collect()}
    for c in "ab":
        order = sorted((x for x in rows if x[0] == c), key=lambda x: (-x[2], x[1]))
        assert [got[c, t] for _, t, _ in order] == list(range(1, 301))
