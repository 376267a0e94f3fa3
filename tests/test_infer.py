"""Types inferred from all values."""

from pyspark.sql import functions as F

from corpuslens.sources import infer


def test_crafted_columns(spark):
    cols = {"a": ["1", "-2", None], "b": ["1", "2.5", "3e4"], "c": ["true", "FALSE", None], "d": ["2024-02-29", "1999-01-01", None],
            "e": ["2024-02-29", "2024-02-28 10:00:00", "2023-02-28T01:02:03.5"], "f": ["1", "x", "3"], "g": [None, None, None],
            "h": ["", "1", "2"], "i": ["2023-02-29", "2023-02-28", "2023-02-27"], "j k": ["1" * 19, "1", "2"]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"`{c}` string" for c in cols))
    got = {r["column_name"]: r for r in infer.evidence(df).collect()}
    assert {c: r["type"] for c, r in got.items()} == {
        "a": "bigint", "b": "double", "c": "boolean", "d": "date", "e": "timestamp", "f": "string", "g": "string",
        "h": "string", "i": "string", "j k": "double"}
    assert (got["f"]["likely"], got["f"]["n_against"], got["f"]["against"]) == ("bigint", 1, "x")
    assert (got["h"]["likely"], got["h"]["against"]) == ("bigint", "")
    assert (got["i"]["likely"], got["i"]["n_against"], got["i"]["against"]) == ("date", 1, "2023-02-29")
    assert got["g"]["likely"] is None and got["g"]["n_null"] == 3
    assert [f.dataType.simpleString() for f in infer.typed(df).schema][:5] == [
        "bigint", "double", "boolean", "date", "timestamp"]
    assert infer.evidence(df.limit(0)).where(F.col("type") != "string").count() == 0


def test_split_does_not_matter(spark):
    df = spark.range(1000).select((F.col("id") % 7 == 0).cast("string").alias("x"), F.col("id").cast("string").alias("y"))
    want = sorted(map(str, infer.evidence(df).collect()))
    for n in (1, 13):
        assert sorted(map(str, infer.evidence(df.repartition(n)).collect())) == want
