import hashlib
import math
from collections import Counter

import numpy as np

from corpuslens.llm import digest as D

from ..conftest import SF_SMALL
from .common import hard, hard_rows, none, prose


def rank():
    r = np.arange(1001)
    return r


def test_entropies():
    data = (prose(200, 1) + "aaaa" * 40 + prose(50, 2)).encode()
    x = np.frombuffer(data, np.uint8)
    got = D.entropies(x)
    for i in range(0, len(got), 7):
        c = Counter(data[i:i + D.WINDOW])
        h = -sum(v / D.WINDOW * math.log2(v / D.WINDOW) for v in c.values())
        assert abs(got[i] - 1000 * h / math.log2(D.WINDOW)) < 1.01


def brute_features(data, rank):
    """Votes run by run, from the definition."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < D.WINDOW:
        return []
    e = D.entropies(x)
    votes = Counter()
    if len(e) < D.RUN:
        votes[min(range(len(e)), key=lambda j: (rank[e[j]], j))] = D.VOTES
    for a in range(len(e) - D.RUN + 1):
        votes[min(range(a, a + D.RUN), key=lambda j: (rank[e[j]], j))] += 1
    return sorted(j for j, v in votes.items() if v >= D.VOTES and e[j] >= D.LOW)


def test_features_and_blocks(monkeypatch):
    texts = [prose(n, n).encode() for n in (3, 8, 15, 40, 400, 900)] + [b"", b"z" * 500, b"q"]
    marks = D.fingerprints(texts, rank())
    for t, m in zip(texts, marks):
        x = np.frombuffer(t, np.uint8)
        assert D._features(x, np.array([0]), np.array([len(x)]), rank()).tolist() == brute_features(t, rank())
        assert D.fingerprints([t], rank()) == [m]
    count = D.histogram(texts)
    assert count.sum() == sum(max(0, len(t) - D.WINDOW + 1) for t in texts)
    monkeypatch.setattr(D, "BLOCK", 300)
    assert D.fingerprints(texts, rank()) == marks and (D.histogram(texts) == count).all()


def test_likeness():
    a, b = prose(3000, 1), prose(3000, 2, [f"w{i}x" for i in range(500)])
    fa, fb, fe, f0 = D.fingerprints([a.encode(), b.encode(), D.edited(a, b).encode(), b""], rank())
    assert D.likeness(fa, fa) == 1 and D.likeness(f0, f0) == 1 and D.likeness(fa, f0) == 0
    assert 0.3 < D.likeness(fa, fe) <= 1 and D.likeness(fa, fb) < 0.1
    assert D.likeness(fa, fe) == D.likeness(fe, fa)


def check(rows, texts, ranges):
    """texts: (id, text) in the expected order, the next one below each."""
    order = sorted(texts, key=lambda t: (t[0] is None, -(t[0] or 0), t[1] is not None, t[1] or ""))
    want = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        want[i, len(t), hashlib.sha256(D.edited(t, u).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = D.digest(docs, ranges=5).collect()
    check(rows, texts, 5)
    by = {r["doc_id"]: r for r in rows}
    same = {}
    for i, t in texts:
        assert same.setdefault(t, by[i]["fingerprint"]) == by[i]["fingerprint"]
        k = len(t) // 3
        if len(t) > 2000:
            assert by[i]["near_edited"] > 0.2, (i, k)


def test_hard_rows(spark):
    texts = [(r[0], r[1]) for r in hard_rows()]
    for n in (1, 4, 30):
        check(D.digest(hard(spark), ranges=n).collect(), texts, n)
    assert D.digest(none(spark)).collect() == []
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    r = D.digest(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0
