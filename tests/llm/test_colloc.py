import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpuslens.llm import colloc as C
from corpuslens.llm import queries as Q

from ..conftest import SF_CHECK, SF_SMALL
from .common import SCHEMA, none, row

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, support, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i:i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    cand = {p: c for p, c in f.items() if len(p) > 2 and c >= support}
    inside = {}
    for p, c in cand.items():
        for i in range(1, len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) - 1:
                    q = (p[0], *p[i:j])
                    inside[q] = max(inside.get(q, 0), c)
    out = {}
    for p, a in cand.items():
        if 100 * inside.get(p, 0) >= 100 * a:
            continue
        cuts = []
        for k in range(2, len(p)):
            left, right = f[p[:k]], f[(p[0], *p[k:])]
            cuts.append((1000 * a * n[p[0]] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(p[0], []).append((" ".join(p[1:]), a, left, right, n[p[0]], score))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        rows += [(lang, k + 1, *x) for k, x in enumerate(found[:top])]
    return sorted(rows)


def made(n, seed):
    r = random.Random(seed)
    words = ["New", "york", "city", "hall", "the", "of", "a", "école", "中文", "x-y", "(b)", "a"]
    sep = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", " ! ", "\r\n", ": ", "\x1c", "\xa0"]
    out = []
    for _ in range(n):
        t = "".join(r.choice(words) + r.choice(sep) for _ in range(r.randint(0, 60)))
        t = t.replace("york", "york city", 1) if r.random() < 0.5 else t
        out.append((t, r.choice(["en", "en", "de", None, "und"])))
    return out + [(None, "en"), ("", "fr"), (" \t. ,", "fr"), ("only", "it"), ("a a a a a a a. a a", "en")] * 3


@pytest.mark.parametrize("support,parts", [(3, 5), (12, 12), (25, 1)])
def test_equals_brute_force(spark, support, parts):
    docs = made(300, support)
    rows = [row(k, t, lang) for k, (t, lang) in enumerate(docs)]
    got = C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(parts, "doc_id").cache(), support, 40)
    assert sorted(map(tuple, got.collect())) == brute(docs, support, 40)


def test_shared_bits_change_nothing(spark, monkeypatch):
    docs = made(120, 9)
    rows = [row(k, t, lang) for k, (t, lang) in enumerate(docs)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9, "doc_id").cache()
    monkeypatch.setattr(C, "_bits", lambda found, by: C.Bits(np.full(1 << 10, 2 ** 64 - 1, np.uint64)))
    want = brute(docs, 9)
    assert sorted(map(tuple, C.collocations(df, 9, shards=3).collect())) == want and want


def test_bits(spark):
    rows = [(s, k * 7919 - 2 ** 62) for s in range(3) for k in range(s, 500, 3)]
    found = spark.createDataFrame(rows, "shard int, key long")
    for shard in (0, 1, 2, None):
        bits = C._bits(found, shard is not None)
        keys = np.array([k for s, k in rows if shard in (s, None)], np.int64).view(np.uint64)
        assert bits.has(keys, shard).all()
        assert bits.has(keys + np.uint64(1), shard).mean() < 0.1


def test_long_texts_are_cut_at_ends_of_pieces(monkeypatch):
    monkeypatch.setattr(C, "GROUP_BYTES", 40)
    text = ("ab cd " * 20 + ". " + "e f. " * 30 + "g" * 100).encode().translate(C._TO)
    parts = list(C._parts(text))
    assert b"".join(parts) == text and len(parts) > 3
    assert all(p[:1] == C._PIECE for p in parts[1:])


def test_places_of_one_hash_are_told_apart():
    g = C.Grams(b"a b  c a b\xff \xffb c\xff" + b"\xff", "en", C.Powers())
    ids = np.array([0, 1, 2, 0, 1, 1, 2])
    h, ok = g.level(2)
    places = np.flatnonzero(ok)
    assert [g.phrase(i, 2) for i in places] == ["a b", "b c", "c a", "a b", "b c"]

    def found():
        return sorted((g.phrase(i, 2), int(n)) for i, n in zip(*C.told_apart(g, 2, places, ids)) if n)

    assert found() == [("a b", 2), ("b c", 2), ("c a", 1)]
    g.hash[2] = np.zeros_like(h)
    assert sum(n for _, n in found()) == 5 and dict(found())["a b"] == 2
    other = C.Grams(b"a b", "de", C.Powers())
    assert other.level(2)[0][0] != h[0] and other.own.tolist() == g.own[:2].tolist()
    assert C.Words(bound=1).fresh()[b"x"] == 0
    for text in (b"", b"\xff", b"  ", b"x"):
        assert [len(C.Grams(text, "en", C.Powers()).level(k)[0]) for k in (1, 2, 5)] == [text == b"x", 0, 0]


def test_empty_and_clashing(spark):
    assert C.collocations(none(spark)).count() == 0
    df = spark.createDataFrame([("a b", None)] * 5, "text string, lang string").selectExpr(
        "*", "1 as n", "2 as score", "'p' as phrase", "3 as shard", "4 as `key`")
    assert [tuple(r) for r in C.collocations(df, 2).collect()] == [("und", 1, "a b", 5, 5, 5, 10, 2000)]


@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(Q.ORACLE_SQL["op11_collocations"]).fetchall()
    got = Q.op11_collocations(spark, sf)
    assert got.columns == [d[0] for d in con.description]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
