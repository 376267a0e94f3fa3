"""Group functions by parts against whole groups in pandas."""

import pandas as pd
import pytest

from corpuslens.operators import grouped


def total(frame):
    return (len(frame), len(frame), int(frame["v"].fillna(0).sum()))


def merged(a, b):
    return (max(a[0], b[0]), a[1] + b[1], a[2] + b[2])


def finished(key, state):
    return [state]


OUT = "most long, n long, s long"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_group_is_never_whole(spark, small_batches):
    rows = spark.range(30_000, numPartitions=7).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('k', id % 700)) AS k", "id AS v")
    want = rows.toPandas().groupby("k")["v"].agg(["size", "sum"])
    for salts in (1, 5, None):
        got = grouped.combine_groups(rows, ["k"], total, merged, finished, OUT, salts).collect()
        assert {r.k: (r.n, r.s) for r in got} == {k: (n, s) for k, n, s in want.itertuples()}
        assert max(r.most for r in got) <= 500


def test_states_are_passed_on_when_many(spark, monkeypatch):
    monkeypatch.setattr(grouped, "HELD", 10)
    monkeypatch.setattr(grouped, "ROWS", 3)
    rows = spark.range(3_000, numPartitions=3).selectExpr("id % 101 AS k", "id AS v")
    got = grouped.combine_groups(rows, ["k"], total, merged, finished, OUT).collect()
    assert {r.k: r.s for r in got} == {k: sum(range(k, 3_000, 101)) for k in range(101)}


def test_nulls_large_numbers_clashing_names_and_no_rows(spark):
    big = (1 << 60) + 1
    rows = spark.createDataFrame([("a", 1.0, big, 1), ("a", 1.0, None, 2), (None, 1.0, 3, 3), ("b", float("nan"), 4, 4),
                                  ("", 2.0, 5, 5)], "state string, salt double, v long, k0 int")
    got = grouped.combine_groups(rows, ["state", "salt"], total, merged, finished, OUT)
    assert got.columns == ["state", "salt", "most", "n", "s"]
    assert {(r.state, r.salt): (r.n, r.s) for r in got.collect()} == {("a", 1.0): (2, big), ("", 2.0): (1, 5)}
    assert grouped.combine_groups(rows.limit(0), ["state"], total, merged, finished, OUT).collect() == []


def test_rows_with_their_group(spark, monkeypatch):
    rows = spark.range(2_000).selectExpr("IF(id % 2 = 0, 0, id % 9) AS k", "id AS v")
    groups = grouped.combine_groups(rows, ["k"], total, merged, finished, OUT)

    def share(frame):
        return pd.DataFrame({"v": frame["v"], "share": frame["v"] / frame["s"]})

    frame = rows.toPandas()
    want = dict(zip(frame["v"], frame["v"] / frame.groupby("k")["v"].transform("sum")))
    for most in (1 << 27, 0):
        monkeypatch.setattr(grouped, "fits_broadcast", lambda df: most > 0)
        got = grouped.map_with_groups(rows, ["k"], groups, share, "v long, share double").collect()
        assert {r.v: r.share for r in got} == pytest.approx(want)
