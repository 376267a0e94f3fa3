import random
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest

from corpuslens.llm import neardup as N
from corpuslens.llm.common import WordHashes, hot_join
from corpuslens.llm.components import components

from .common import SCHEMA, hard, none, prose, row


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def similarity(a, b):
    a, b = (N.shingles(WordHashes().of(N.words_of(t))).tolist() for t in (a, b))
    return 1 - levenshtein(a, b) / max(len(a), len(b), 1)


def test_banded_alignment():
    r = random.Random(1)
    pairs = []
    for _ in range(300):
        a = [r.randint(0, 30) for _ in range(r.randint(1, 60))]
        b = list(a)
        for _ in range(r.randint(0, 12)):
            k, o = r.randint(0, len(b)), r.random()
            if o < .4:
                b[k:k + 1] = [r.randint(0, 30)]
            elif o < .7:
                b.insert(k, r.randint(0, 30))
            elif len(b) > 1:
                del b[k:k + 1]
        pairs.append((np.array(a, np.uint64), np.array(b or [1], np.uint64)))
    true = np.array([levenshtein(list(a), list(b)) for a, b in pairs])
    for band in (0, 1, 3, 8, 60):
        d = N.distances(pairs, [band] * len(pairs))
        assert np.where(true <= band, d == true, d > band).all()
    alike = 1 - true / np.array([max(len(a), len(b)) for a, b in pairs])
    assert (N.similar(pairs, 0.8) == (alike >= 0.8 - 1e-9)).all()
    assert all(N.anchored(a, b) >= t for (a, b), t in zip(pairs, true))


def test_sketch(monkeypatch):
    r = np.random.default_rng(0)
    s = N.shingles(r.integers(0, 50, 3000).astype(np.uint64))
    lab = N.labelled(s)
    assert len(set(lab.tolist())) == len(lab)
    with np.errstate(over="ignore"):
        h = (lab[None, :] ^ N._SEEDS[:, None]) * N._FACTORS[:, None]
    at = np.argsort(h, axis=1)[:, :N.PICK]
    low = np.take_along_axis(h, np.sort(at, axis=1), 1)
    out = N._SEEDS.copy()
    with np.errstate(over="ignore"):
        for j in range(N.PICK):
            out = N.mix(out * np.uint64(31) + low[:, j])
    assert (N.sketch(s) == out).all()
    monkeypatch.setattr(N, "BLOCK", 100)  # long texts, block by block
    assert (N.sketch(s) == out).all()
    # Order counts: the same shingles the other way round agree on fewer lanes.
    assert (N.sketch(s) == N.sketch(s[::-1])).mean() < 0.5


def test_signature_bounds_the_distance():
    r = random.Random(3)
    for _ in range(200):
        a = [r.randint(0, 400) for _ in range(r.randint(1, 80))]
        b = [x for x in a if r.random() < 0.8] or [1]
        a, b = (N.shingles(np.array(x, np.uint64)) for x in (a, b))
        x, y = (np.unpackbits(N.signature(s).view(np.uint8)) for s in (a, b))
        d = levenshtein(a.tolist(), b.tolist())
        assert (x & ~y & 1).sum() <= d and (y & ~x & 1).sum() <= d


def test_components(spark):
    r = random.Random(7)
    chain = [(i, i + 1) for i in range(100, 140)]
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(30)] + chain + [
        (200, x) for x in range(201, 260)] + [(5, None), (None, 5), (None, None)]
    r.shuffle(edges)
    got = {x["node"]: x["label"] for x in
           components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    least = defaultdict(lambda: 10 ** 9)
    for x in parent:
        least[find(x)] = min(least[find(x)], x)
    assert got == {x: least[find(x)] for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def near(text, share, seed, vocab=None):
    """A copy with some words replaced."""
    r = random.Random(seed)
    return " ".join(r.choice(["zza", "zzb", "zzc"]) if r.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    out, words = [], [f"w{i}" for i in range(400)]
    passage = prose(60, 999, words)
    for g in range(12):
        base = prose(150 + 20 * g, g, words)
        out += [base, base.upper(), near(base, 0.01, g), near(base, 0.02, 50 + g), near(base, 0.3, 90 + g)]
    out += [prose(150, 500 + i, words) + " " + passage for i in range(25)]  # a shared passage
    hot = prose(200, 1000, words)
    out += [near(hot, 0.015, 2000 + i) for i in range(60)]  # one large group of near copies
    out += ["short text", "Short, text!", "short texts", "", "?!"]
    random.Random(1).shuffle(out)
    return list(enumerate(out))


def test_groups_equal_brute_force(spark, corpus):
    rows = N.groups_of(spark.createDataFrame([row(i, t) for i, t in corpus], SCHEMA)).collect()
    got = {r["doc_id"]: r["group_id"] for r in rows}
    seqs = {i: N.shingles(WordHashes().of(N.words_of(t))) for i, t in corpus}
    parent = {i: i for i, _ in corpus}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i, _ in corpus]
    pairs = [(a, b) for a in ids for b in ids if a < b]
    yes = N.similar([(seqs[a], seqs[b]) for a, b in pairs], 0.8)
    for (a, b), y in zip(pairs, yes):
        if y:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {i: find(i) for i in ids}
    assert sorted(r["doc_id"] for r in rows if r["first"]) == sorted(set(got.values()))


def test_first_of_groups(spark, corpus):
    docs = spark.createDataFrame([row(i, t) for i, t in corpus], SCHEMA)
    groups = {r["doc_id"]: r["group_id"] for r in N.groups_of(docs).collect()}
    kept = N.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))


def test_hard_rows(spark):
    rows = N.groups_of(hard(spark)).collect()
    assert len(rows) == hard(spark).count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["group_id"])
    assert by[6] == {1} and by[2] == {2} and by[3] == by[4] == by[7] == by[8]
    kept = N.first_of_groups(hard(spark)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] in (1, 2, 6)) == [1, 2]
    assert len([r for r in kept if r["doc_id"] == 3]) == 1
    assert len([r for r in kept if r["doc_id"] is None]) == 1
    assert N.groups_of(none(spark)).collect() == [] and N.first_of_groups(none(spark)).collect() == []


def test_short_texts_equal_brute_force(spark):
    """Texts of 8 to 25 words (and a little more) at a similarity of 0.8: no link is lost."""
    r, out = random.Random(11), []
    words = [f"w{i}" for i in range(3000)]
    line = [r.choice(words) for _ in range(9)]  # a common line must not make links
    for n in range(4, 60):
        for k in range(4):
            base = [r.choice(words) for _ in range(n)]
            if k == 3:
                base = line + base
            allowed = max(1, (len(base) - 4) // 5)
            out += [base, base + ["zz"] * k, ["zy"] + base[1:], base[:-1] + ["zx"],
                    base[allowed:], base[:-allowed], ["za"] * allowed + base[allowed:]]
    texts = sorted({" ".join(t) for t in out})
    rows = N.groups_of(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)).collect()
    got = {x["doc_id"]: x["group_id"] for x in rows}
    seqs = [N.shingles(WordHashes().of(N.words_of(t))) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = [(a, b) for b in range(len(texts)) for a in range(b)
             if abs(len(seqs[a]) - len(seqs[b])) <= 0.2 * max(len(seqs[a]), len(seqs[b])) + 1e-9]
    yes = N.similar([(seqs[a], seqs[b]) for a, b in pairs], 0.8)
    assert yes.sum() > 1000
    for (a, b), y in zip(pairs, yes):
        if y:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    assert got == {i: find(i) for i in range(len(texts))}
    # 8 words and the same 8 plus one; two texts of 9 words that differ in the last.
    short = ["a b c d e f g h", "a b c d e f g h i", "k l m n o p q r s", "k l m n o p q r t"]
    rows = N.groups_of(spark.createDataFrame([row(i, t) for i, t in enumerate(short)], SCHEMA)).collect()
    assert {x["doc_id"]: x["group_id"] for x in rows} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_links_of_near_copies_are_linear(spark, monkeypatch):
    """One group of short near copies: the finishing blocks give a forest, not every pair."""
    words = [f"w{i}" for i in range(300)]
    base, made = prose(36, 4, words).replace(".", ""), N._finished
    sizes, found = (100, 200, 400), []

    def finished(*args):
        found.append(made(*args))
        return found[-1]

    monkeypatch.setattr(N, "_finished", finished)
    for n in sizes:
        texts = [near(base, 0.04, 10 * n + i) for i in range(n)]
        rows = N.groups_of(spark.createDataFrame([row(i, x) for i, x in enumerate(texts)], SCHEMA)).collect()
        largest = max(Counter(r["group_id"] for r in rows).values())
        assert largest > 0.5 * n
    assert all(f.count() < n for f, n in zip(found, sizes))


def test_forest_joins_what_all_pairs_join():
    r = random.Random(8)
    texts = [np.array([r.randint(0, 3) if r.random() < 0.1 else k + 10 * g for k in range(20)], np.uint64)
             for g in range(5) for _ in range(14)]
    a, b = texts, texts[::-1]
    la = [min(i, 3) if i < 14 else i for i in range(70)]
    lb = la[::-1]
    yes = N.similar([(x, y) for x in a for y in b], 0.8)
    pairs = [(la[k // 70], lb[k % 70]) for k in np.flatnonzero(yes)]
    links = N.forest(la, a, lb, b, 0.8, step=7)

    def parts(edges):
        label = {x: x for x in la}
        for x, y in edges:
            x, y = label[x], label[y]
            label = {k: x if v == y else v for k, v in label.items()}
        return sorted(sorted(k for k in label if label[k] == v) for v in set(label.values()))

    got = [(la[i], lb[j]) for i, j in links]
    assert parts(got) == parts(pairs) and len(got) == len(set(la)) - len(parts(pairs))


def test_hot_keys_change_nothing(spark, corpus, monkeypatch):
    from corpuslens.llm import components as K

    hot = partial(hot_join, hot=3)
    big = spark.createDataFrame([(k % 3 if k < 30 else k, k) for k in range(40)] + [(None, 1)], "k long, v long")
    small = spark.createDataFrame([(k, -k) for k in range(0, 36, 2)], "k long, w long")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, "k", how).collect()))
        assert sorted(map(str, hot(big, small, "k", how).collect())) == want
    edges = spark.createDataFrame([(1, x) for x in range(2, 30)] + [(40, x) for x in range(41, 60)], "a long, b long")
    more = spark.createDataFrame([(5, 45), (70, 71), (71, 7), (80, 81)], "a long, b long")
    want = sorted(map(tuple, components(edges.unionByName(more)).collect()))
    monkeypatch.setattr(K, "hot_join", hot)
    monkeypatch.setattr(N, "hot_join", hot)
    assert sorted(map(tuple, K.merged(K.merged(None, edges), more).collect())) == want
    rows = [row(i, t) for i, t in corpus[:80]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"], r["group_id"]) for r in N.groups_of(docs).collect())
    monkeypatch.setattr(K, "hot_join", hot_join)
    monkeypatch.setattr(N, "hot_join", hot_join)
    assert got == sorted((r["doc_id"], r["group_id"]) for r in N.groups_of(docs).collect())


def test_lanes_find_texts_at_the_limit():
    """Recall of the lanes alone, for texts of 46 to 200 words at a similarity just above 0.8."""
    r, hit, n = random.Random(12), 0, 0
    hashes = WordHashes()
    while n < 300:
        size = r.randint(46, 200)
        a = [f"v{r.randint(0, 10 ** 6)}" for _ in range(size)]
        b = list(a)
        for at in r.sample(range(size), max(1, size // 25)):
            b[at] = "edited"
        x, y = (N.shingles(hashes.of(t)) for t in (a, b))
        d = N.distances([(x, y)], [len(x)])[0] / len(x)
        if 0.15 < d <= 0.2:
            n += 1
            hit += bool((N.sketch(x) == N.sketch(y)).any())
    assert hit / n > 0.99
