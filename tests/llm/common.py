"""Rows that every operator must stand: nulls, empty and very long texts, ties, repeated rows and
columns whose names clash with the operators' own."""

import random

WORDS = ("the of and to that was with from house which les des une dans pour avec était und der "
         "nicht über schön werden los para como niño casa después thing order").split()

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, "
          "c0 int, label string, _id int, text_a string, `range` int, mark long, part int, n int")


def prose(n, seed, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(n))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text) if text is not None else None, "k", 1, "l", 2, "t",
            3, 4, 5, 6)


def hard_rows():
    long = prose(30_000, 5)
    return [row(1, prose(60, 1)), row(2, prose(60, 2)), row(2, prose(60, 2)), row(3, None),
            row(4, ""), row(5, long), row(6, prose(60, 1)), row(None, prose(40, 3)),
            row(7, "  \n\t "), row(8, "!!! ... ***"), row(9, prose(60, 4), None),
            row(10, "x" * 5000), row(11, "A"), row(3, None), row(-7, "ﬁ ² ① 中文 ▁ \u0000 😀 é"),
            row(12, "12.34.56.78 a.b@c.de +1 (555) 555-1234 4111 1111 1111 1111")]


def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
