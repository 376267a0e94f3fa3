import os
import tempfile

from pyspark.sql import functions as F

from corpuslens.operators import clean
from corpuslens.streaming import clean_stream as S


def test_stream_cleaning_equals_batch(spark):
    src = "/root/testdata/sf0.001/documents*.parquet"  # a glob: file streams watch folders
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "lang")
    out = tempfile.mkdtemp(prefix="cl-stream-", dir="/tmp")
    stream = S.read_posts_stream(spark, src, docs.schema)
    q = S.write_stream(S.clean_stream(stream, "text"), os.path.join(out, "clean"),
                       os.path.join(out, "checkpoint"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(out, "clean"))
    batch = clean.clean_table(docs, "text", "basic")
    assert got.count() == docs.count()
    # Started again with its checkpoint, it has nothing left to do.
    again = S.write_stream(S.clean_stream(S.read_posts_stream(spark, src, docs.schema), "text"),
                           os.path.join(out, "clean"), os.path.join(out, "checkpoint"))
    again.awaitTermination(120)
    assert spark.read.parquet(os.path.join(out, "clean")).count() == docs.count()
    assert got.select("doc_id", "clean_post", "nr_of_words").exceptAll(
        batch.select("doc_id", "clean_post", "nr_of_words")).count() == 0


def test_stream_class_counts(spark):
    src = "/root/testdata/sf0.001/documents*.parquet"  # a glob: file streams watch folders
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "lang")
    stream = S.read_posts_stream(spark, src, docs.schema)
    q = S.write_stream(S.class_counts_stream(stream, "lang"), "class_counts_test",
                       tempfile.mkdtemp(prefix="cl-counts-", dir="/tmp"), mode="complete", fmt="memory")
    q.awaitTermination(120)
    got = {r.lang: r.n for r in spark.sql("SELECT * FROM class_counts_test").collect()}
    exp = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    assert got == exp
