from pyspark.sql import functions as F

from corpuslens.llm.common import drawn


def test_shares_of_any_size(spark):
    rows = spark.range(200_000)

    def n(share):
        return rows.where(drawn(share, "id")).count()

    assert n(1.0) == n(7.5) == 200_000
    assert 1_700 < n(0.01) < 2_300
    assert rows.where(drawn(F.col("id") * 0 + 0.5, "id")).count() == n(0.5)
    # A bound of 3,000 rows out of 1e11 is a share of 3e-8: far below 2^-20, and not nothing.
    assert 0 < spark.range(2 * 10 ** 8).where(drawn(3e-8, "id")).count() < 40
