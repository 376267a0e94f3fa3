import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import hardneg as H
from corpuslens.llm import queries as Q

from ..conftest import SF_CHECK, SF_SMALL

SCHEMA = ("vec_id long, embedding array<double>, label int, id string, vec int, grp int, chunk int, "
          "windows string, rank int, `a b` int")


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """Every anchor (id divisible by 50) against every row, with Python's own numbers."""
    best = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(c is None or not np.isfinite(c) for c in v):
            continue
        v = [int(np.floor(256.0 * c)) for c in v]
        if sum(c * c for c in v) < 2 ** 62 and (i not in best or (label, v) < best[i]):
            best[i] = label, v
    out = []
    for a, (label, v) in best.items():
        if a % 50:
            continue
        score = {i: sum(p * q for p, q in zip(v, w)) for i, (_, w) in best.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label][:positives]:
            fit = [i for i in order if best[i][0] != label
                   and low * score[p] <= 100 * score[i] <= high * score[p]][:negatives]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "w", 4, 5) for r in rows], SCHEMA)


def mined(spark, rows):
    return sorted(map(tuple, H.mine(table(spark, rows), F.col("id") % 50 == 0).collect()))


def made(n, seed, dim=6, centres=9, noise=0.2):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    return [(int(i), [float(z) for z in c[k] + noise * r.normal(size=dim)], int(r.integers(0, 4)))
            for i, k in enumerate(r.integers(0, centres, n))]


@pytest.mark.parametrize("group,chunk,block", [(1024, 1 << 21, 1024), (7, 600, 16)])
def test_equals_brute_force(spark, monkeypatch, group, chunk, block):
    monkeypatch.setattr(H, "GROUP", group)
    monkeypatch.setattr(H, "CHUNK", chunk)
    monkeypatch.setattr(H, "WIDTH", 3)
    monkeypatch.setattr(H, "BLOCK", block)
    rows = made(900, 1)
    same = [(i, [0.5, 0.25, -1.0, 0.0, 2.0, 1.0], i % 3) for i in range(900, 1200)]  # ties
    assert mined(spark, rows + same) == brute(rows + same)


def test_hard_rows(spark):
    r = random.Random(3)
    rows = made(120, 2) + [
        (None, [1.0] * 6, 1), (150, None, 1), (200, [1.0] * 6, None), (250, [1.0, None], 1),
        (300, [float("nan")] * 6, 2), (350, [float("inf"), 1.0], 2), (400, [], 1), (450, [2.0], 1),
        (500, [0.0] * 6, 2), (550, [1e300] * 6, 1), (600, [-3.0] * 6, 3), (650, [2.0] * 9, 1),
        (700, [8e6 + 0.37] * 6, 1), (701, [8e6 - 0.9] * 6, 1), (702, [7.3e6 + 1 / 3] * 6, 2), (703, [7e6] * 6, 2),
        (50, [r.random() for _ in range(6)], 0), (50, [9.0] * 6, 9), (-50, [1.5] * 6, 1), (-7, [1.0] * 6, 2)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [(0, [1.0], 1)]) == [] == mined(spark, [])


def test_bounds_spare_pairs():
    rng = np.random.default_rng(5)
    a = np.floor(256 * (np.repeat(rng.normal(size=(4, 16)), 50, 0) + 0.01 * rng.normal(size=(200, 16)))).astype(
        np.int64)
    x = np.floor(256 * rng.normal(size=(500, 16))).astype(np.int64)
    parent, edge = H.spanning_tree(a)
    got = {}
    s = a @ x.T
    top = np.sort(s, 1)[:, -3:][:, :1]
    n = H.walk(a, parent, edge, x, lambda lev, lo, hi, at: hi >= top[lev],
               lambda i, j, v: got.update({(p, q): w for p, q, w in zip(i, j, v)}))
    assert all(got[i, j] == s[i, j] for i, j in zip(*np.nonzero(s >= top)))
    assert n < 0.5 * s.size


def test_tree_is_minimal():
    rng = np.random.default_rng(6)
    a = rng.integers(-50, 50, (40, 3))
    a[10:14] = a[9]
    parent, edge = H.spanning_tree(a)
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(2))
    pairs, root = sorted((d[i, j], i, j) for i in range(40) for j in range(i)), list(range(40))
    total = 0.0
    for w, i, j in pairs:  # the shortest edge between two parts, over and over
        if root[i] != root[j]:
            total += w
            old = root[i]
            root = [root[j] if x == old else x for x in root]
    assert abs(edge.sum() - total) < 1e-3
    assert sorted(np.concatenate(H.layers(parent)).tolist()) == list(range(40))


@pytest.mark.parametrize("sf", [SF_SMALL, SF_CHECK])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(Q.ORACLE_SQL["op12_hardneg"]).fetchall()
    got = Q.op12_hardneg(spark, sf)
    assert got.columns == [d[0] for d in con.description]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
