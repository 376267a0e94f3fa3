"""CSV round trip and renames."""

import random

from corpuslens.schema import POSTS
from corpuslens.session import ensure_checkpoint_dir
from corpuslens.sources import csv
from corpuslens.sources.io import read_posts, read_table, write_posts

from .conftest import SF_SMALL


def test_csv_keeps_spaces_empty_and_null(spark):
    rows = [(1, "a", "  padded  ", "x"), (2, "", "", None), (3, None, None, "y"),
            (4, "q", 'quote " and , comma', "z"), (5, "n", "two\nlines\r\n", "\\"), (6, "t", "\t", " ")]
    df = spark.createDataFrame(rows, POSTS)
    path = ensure_checkpoint_dir(spark) + "/csv-test"
    write_posts(df, path, fmt="csv")
    back = read_posts(spark, path, fmt="csv")
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_renames_keep_the_schema(spark):
    df = spark.createDataFrame([(1, "a", "p", "x")], "doc_id long, auhtor_ID string, post string, leaning string")
    path = ensure_checkpoint_dir(spark) + "/csv-renamed"
    write_posts(df, path, fmt="csv")
    back = read_posts(spark, path, fmt="csv", renames={"auhtor_ID": "author_id", "leaning": "class"})
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in POSTS]
    assert [tuple(r) for r in back.collect()] == [(1, "a", "p", "x")]
    path += "-parquet"
    write_posts(df, path)
    back = read_posts(spark, path, renames={"auhtor_ID": "author_id", "leaning": "class"})
    assert back.columns == ["doc_id", "author_id", "post", "class"]


def hostile(n, seed):
    r = random.Random(seed)
    bits = ['"', '""', ",", "\n", "\r\n", "\n\n", "word", " ", "é", "\\N", "\\", "'", "\r", "a,b\n\"c\""]

    def text():
        k = r.random()
        return None if k < 0.1 else r.choice(["", "\\N", "\\\\N", "N", '"', "\n", " "]) if k < 0.3 else "".join(
            r.choice(bits) for _ in range(r.randint(0, 12)))

    return [(k, text(), text(), text()) for k in range(n)]


def test_one_file_is_read_by_many_tasks(spark):
    rows = hostile(4000, 1) + [(4001, "q", "long\n" * 3000 + '"', "z"), (4002, None, None, None)]
    path = ensure_checkpoint_dir(spark) + "/csv-large"
    write_posts(spark.createDataFrame(rows, POSTS).coalesce(1), path, fmt="csv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (997, 20_011):  # blocks that begin anywhere, also inside fields and inside long ones
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            back = read_posts(spark, path, fmt="csv")
            assert csv.lines(spark, path).rdd.getNumPartitions() > 5
            assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_foreign_csv(spark, tmp_path):
    """Line ends of two characters, quotes only where needed, empty lines, several files, one without rows; an empty
    field without quotes is NULL."""
    (tmp_path / "a.csv").write_bytes(b'doc_id,author_id,post,class\r\n1,a,"x\r\ny, ""q""",en\r\n\r\n2,,plain,\\N\r\n')
    (tmp_path / "b.csv").write_bytes(b'"doc\nid",author_id,post,class\n3,b,"",de')
    (tmp_path / "c.csv").write_bytes(b"doc_id,author_id,post,class\n")
    got = sorted(map(tuple, read_posts(spark, str(tmp_path), fmt="csv").collect()))
    assert got == [(1, "a", 'x\r\ny, "q"', "en"), (2, None, "plain", None), (3, "b", "", "de")]


def test_all_tables_through_csv(spark):
    """Every column without nesting of every table, typed again by the schema."""
    for name in ("documents", "pages", "orders", "labels", "conversations"):
        df = read_table(spark, SF_SMALL, name)
        path = ensure_checkpoint_dir(spark) + f"/csv-{name}"
        write_posts(df, path, fmt="csv")
        back = read_posts(spark, path, fmt="csv", schema=df.schema)
        assert back.exceptAll(df).count() == 0 == df.exceptAll(back).count()


def test_names_from_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('auhtor_ID,"my ""post""","a,b"\n1,x,\n')
    back = read_posts(spark, str(tmp_path), fmt="csv", schema=None, renames={"auhtor_ID": "author_id"})
    assert back.columns == ["author_id", 'my "post"', "a,b"] and [tuple(r) for r in back.collect()] == [("1", "x", None)]
