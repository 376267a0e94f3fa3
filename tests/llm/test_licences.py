import re
import time

from corpuslens.llm import licences as L

from ..conftest import SF_SMALL
from .common import hard, none, row, SCHEMA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """(n_words, starts, base labels) straight from the definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    starts, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), starts, ",".join(sorted(labels))


def check(rows, texts):
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        n, starts, labels = brute(t)
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(starts), labels)
        assert r["first_word"] == (min(starts) if starts else None)
        assert r["last_word"] == (max(starts) if starts else None)
        assert 0 <= r["score"] <= 1 and set(filter(None, labels.split(","))) <= set(r["labels"].split(","))


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.select("text").collect()]
    check(L.scan(docs).orderBy("doc_id").collect(), texts)


def test_places_and_overlaps(spark):
    texts = ["MIT license, mit-License! MIT", "the CC, BY cc by by", "apache license license",
             "GNU\ngeneral PUBLIC licensE apache  license", "xmit license", "émit license mit license",
             "gnu general public licenses", "cc by cc by cc by"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check(L.scan(docs).orderBy("doc_id").collect(), texts)


def test_hard_rows(spark):
    texts = [r["text"] for r in hard(spark).collect()]
    check(L.scan(hard(spark).coalesce(1)).collect(), texts)
    assert L.scan(none(spark)).collect() == []


def test_expressions(spark):
    assert L.parse("MIT OR Apache-2.0 AND GPL-2.0") == ["mit", "apache-2.0", "gpl-2.0", "and", "or"]
    assert L.parse("(MIT or X) and GPL-2.0-only WITH Classpath-exception-2.0") == [
        "mit", "x", "or", "gpl-2.0-only", "classpath-exception-2.0", "with", "and"]
    for bad in ("", "or", "mit or", "(mit", "mit)", "mit apache", "and mit", "mit with (a or b)"):
        got = L.parse(bad)
        assert got is None or L.evaluate(got) is None
    assert L.evaluate(L.parse("MIT OR GPL-3.0")) == ({"mit", "gpl-3.0"}, True)
    assert L.evaluate(L.parse("MIT AND GPL-3.0")) == ({"mit", "gpl-3.0"}, False)
    text = "x\n// SPDX-License-Identifier: (MIT OR GPL-2.0-only) \n/* spdx-license-identifier: 0BSD */"
    r = L.scan(spark.createDataFrame([row(1, text)], SCHEMA)).first()
    assert (r["n_tags"], r["labels"], r["permissive"]) == (2, "0bsd,gpl-2.0-only,mit", True)
    assert r["expressions"] == ["mit gpl-2.0-only or", "0bsd"]


def test_linear_time():
    import pyarrow as pa

    texts = ["SPDX-License-Identifier: MIT" + " " * 1_000_000 + "*/ x", "mit license " * 1_000_000,
             "SPDX-License-Identifier: " + " " * 500_000 + "Apache-2.0" + " " * 500_000 + "*/\n",
             "gnu general public license mit license x apache license"]
    begin = time.time()
    got = L._scanner()(pa.RecordBatch.from_pydict({"text": texts}))
    assert time.time() - begin < 30
    assert got["n_base"] == [0, 1_000_000, 0, 3]
    assert got["first_word"][1:] == [0, None, 0] and got["last_word"][1:] == [1_999_998, None, 7]
    assert got["expressions"][2] == ["apache-2.0"]
    for line in ("MIT */", "MIT  */ \t", "MIT", "MIT --> ", " a *) *) ", "*/", "", " -- >"):
        assert L.without_ending(line) == re.sub(r"\s*(\*/|-->|\*\))?\s*$", "", line)
