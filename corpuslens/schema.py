"""Fixed schemas (no inferred types anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

POSTS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("author_id", T.StringType(), True),
    T.StructField("post", T.StringType(), True),
    T.StructField("class", T.StringType(), True),
])

CLEAN = T.StructType(POSTS.fields + [
    T.StructField("clean_post", T.StringType(), True),
    T.StructField("nr_of_words", T.LongType(), True),
    T.StructField("nr_of_characters", T.LongType(), True),
    T.StructField("label", T.IntegerType(), True),
])

