from collections import Counter

from pyspark.sql import functions as F

from corpuslens.operators import sample
from corpuslens.operators.topk import hash_rank, top_k


def _groups(spark, sizes):
    rows, i = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            rows.append((i, g))
            i += 1
    return spark.createDataFrame(rows, "id long, g string")


def test_cap_keeps_small_groups_whole(spark):
    df = _groups(spark, {"a": 1, "b": 3, "c": 20})
    got = Counter(r.g for r in sample.cap_per_group(df, "g", "id", k=3).collect())
    assert got == {"a": 1, "b": 3, "c": 3}


def test_cap_null_keys_excluded(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id long, g string")
    assert [r.id for r in sample.cap_per_group(df, "g", "id", k=5).collect()] == [2]


def test_balance_modes(spark):
    df = _groups(spark, {"a": 2, "b": 5, "c": 9})
    down = Counter(r.g for r in sample.balance(df, "g", "id", "down").collect())
    boot = sample.balance(df, "g", "id", "bootstrap").collect()
    up = sample.balance(df, "g", "id", "up").collect()
    assert down == {"a": 2, "b": 2, "c": 2}
    assert Counter(r.g for r in boot) == {"a": 2, "b": 2, "c": 2}
    assert Counter(r.g for r in up) == {"a": 9, "b": 9, "c": 9}
    # 'up' keeps every original row once
    assert sorted(r.id for r in up if r.draw is None) == list(range(16))


def test_samples_do_not_depend_on_partitioning(spark):
    df = _groups(spark, {"a": 40, "b": 300, "c": 7})
    ref = sorted(r.id for r in sample.cap_per_group(df, "g", "id", k=11).collect())
    for n in (1, 7, 64):
        got = sorted(r.id for r in sample.cap_per_group(df.repartition(n), "g", "id", k=11).collect())
        assert got == ref
    boot = sorted((r.id, r.draw) for r in sample.balance(df, "g", "id", "bootstrap").collect())
    boot7 = sorted((r.id, r.draw) for r in sample.balance(df.repartition(7), "g", "id",
                                                          "bootstrap").collect())
    assert boot == boot7


def test_hash_rank_equals_global_rank(spark):
    df = _groups(spark, {"hot": 3000, "b": 50, "c": 1})
    df = df.withColumn("h", sample.order_key("id"))
    got = {(r.g, r.id): r.rank for r in hash_rank(df, ["g"], "h", "id").collect()}
    pdf = df.toPandas().sort_values(["g", "h", "id"])
    pdf["rank"] = pdf.groupby("g").cumcount() + 1
    assert got == {(g, i): r for g, i, r in zip(pdf.g, pdf.id, pdf["rank"])}


def test_top_k_equals_sorting(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", float((i * 37) % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, s double")
    got = sorted((r.g, r.id, r.rank) for r in
                 top_k(df, ["g"], [F.col("s").desc(), F.col("id").asc()], 5).collect())
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["id", "g", "s"]).sort_values(["g", "s", "id"],
                                                                   ascending=[True, False, True])
    pdf["rank"] = pdf.groupby("g").cumcount() + 1
    exp = sorted((g, i, r) for g, i, r in zip(pdf.g, pdf.id, pdf["rank"]) if r <= 5)
    assert got == exp


def test_hash_split_disjoint_covering(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "doc_id")
    s = sample.hash_split(df, "doc_id", 0.8).collect()
    assert len(s) == 5000 and {r.split for r in s} == {"train", "test"}
    frac = sum(r.split == "train" for r in s) / 5000
    assert 0.77 < frac < 0.83


def test_wide_hashes_reach_beyond_32_bits(spark):
    h = [r.h for r in spark.range(2000).select(sample.hash_wide(F.col("id")).alias("h")).collect()]
    assert min(h) >= 0 and max(h) < 1 << 60 and max(h) > 1 << 59 and len(set(h)) == 2000
    sizes = spark.createDataFrame([("a", 10 ** 11, 3000)], "g string, _size long, need long")
    pos = [r._pos for r in sample._draws(sizes, "g", "need", 1).collect()]
    assert len(pos) == 3000 and max(pos) > 9 * 10 ** 10 and min(pos) < 10 ** 10
