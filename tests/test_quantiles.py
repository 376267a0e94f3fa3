"""Mergeable quantile sketches against exact quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import quantiles as Q


def table(spark, n=20_000):
    return spark.range(n, numPartitions=5).selectExpr(
        "id", "IF(id % 3 = 0, 'hot', concat('g', id % 5)) AS g", "id % 30 AS day",
        "CAST(pow(id * 7919 % 10007, 1.5) AS double) AS x")


def as_dict(sketches):
    return {r.g: (r.n, [tuple(s) for s in r["sample"]]) for r in sketches.collect()}


def test_merging_in_any_order_gives_the_sketch_of_all(spark):
    df = table(spark)
    whole = as_dict(Q.sketch(df, ["g"], "x", "id", k=300))
    days = Q.sketch(df, ["g", "day"], "x", "id", k=300)
    assert as_dict(Q.merge(days, ["g"], 300)) == whole
    weeks = Q.merge(days.withColumn("week", F.col("day") % 4), ["g", "week"], 300)
    assert as_dict(Q.merge(weeks, ["g"], 300)) == whole
    parts = [Q.merge(days.where(f"day % 2 = {i}"), ["g"], 300) for i in (1, 0)]
    assert as_dict(Q.merge(parts[0].unionByName(parts[1]), ["g"], 300)) == whole
    assert as_dict(Q.sketch(df.repartition(13), ["g"], "x", "id", k=300)) == whole
    assert all(len(s) == min(n, 300) for n, s in whole.values())


def test_rank_error_holds(spark):
    df = table(spark)
    qs = [0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0]
    xs = {g: np.sort(f["x"].to_numpy()) for g, f in df.toPandas().groupby("g")}
    got = Q.quantiles(Q.sketch(df, ["g"], "x", "id", k=500), ["g"], qs).collect()
    assert len(got) == len(qs) * len(xs)
    for r in got:
        x = xs[r.g]
        assert r.n == len(x) and 0 < r.rank_error < 0.11
        low, high = np.searchsorted(x, r.value, "left") / len(x), np.searchsorted(x, r.value, "right") / len(x)
        assert low - r.rank_error <= r.q <= high + r.rank_error


def test_few_rows_are_exact_and_odd_rows_defined(spark):
    rows = spark.createDataFrame([(1, "a", 3.0), (2, "a", 1.0), (3, "a", None), (4, None, 9.0), (5, "a", float("nan")),
                                  (6, "b", 4.0), (2, "a", 1.0)], "id long, g string, x double")
    got = Q.quantiles(Q.sketch(rows, ["g"], "x", "id"), ["g"], [0.5, 0.75]).collect()
    assert {(r.g, r.q): (r.n, r.value, r.rank_error) for r in got} == {
        ("a", 0.5): (3, 1.0, 0.0), ("a", 0.75): (3, 2.0, 0.0), ("b", 0.5): (1, 4.0, 0.0), ("b", 0.75): (1, 4.0, 0.0)}
    assert Q.merge(Q.sketch(rows.limit(0), ["g"], "x", "id"), ["g"]).collect() == []
    with pytest.raises(ValueError):
        Q.sketch(rows, [], "x", "id")
