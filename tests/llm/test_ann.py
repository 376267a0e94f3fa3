import numpy as np

from corpuslens.llm import ann as A
from corpuslens.llm.queries import op5_ann

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, v string, part int, rb int, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, "v", 1, 2, 3) for i, e in rows], SCHEMA)


def brute(rows, k=10):
    """Exact answers of the rows that take part."""
    good = {}
    for i, e in rows:
        if i is not None and e is not None and None not in e and np.isfinite(e).all() and any(e):
            good.setdefault(len(e), []).append((i, np.float32(e).astype(float)))
    if not good:
        return {}
    pool = good[max(good, key=lambda s: (len(good[s]), -s))]
    out = {}
    for q in sorted({i for i, _ in pool if i % 100 == 0}):
        x = min((tuple(v) for i, v in pool if i == q))
        best = {}
        for i, v in pool:
            if i != q:
                d = np.sqrt(((np.array(x) - v) ** 2).sum())
                best[i] = min(best.get(i, np.inf), d)
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def run(spark, rows, **kw):
    t = table(spark, rows)
    return got(A.search(t, t.where("vec_id % 100 = 0"), **kw))


def test_recall_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, found = brute(rows), got(op5_ann(spark, SF))
    assert set(want) == set(found)
    hit = sum(len({i for _, i in want[q]} & {i for _, i in found[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    exact = {i: np.float32(e).astype(float) for i, e in rows}
    for q, answers in found.items():
        assert answers == sorted(answers) and len(answers) == 10
        for d, i in answers:
            assert abs(d - np.sqrt(((exact[q] - exact[i]) ** 2).sum())) < 1e-12


def test_hard_rows(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]),
            (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
            (200, [5.0, 5.0]), (2, [0.0, 1.0]), (9, [4.0, 4.0]), (9, [1.0, 0.5]), (300, None), (100, [1.0, 0.0]),
            (10, [-0.0, 1.0])]
    assert run(spark, rows) == {q: [(d, i) for d, i in a] for q, a in brute(rows).items()}
    assert run(spark, [(100, [1.0])]) == {} and run(spark, [(1, None), (100, [0.0])]) == {}
    assert A.search(table(spark, []), table(spark, [])).collect() == []


def test_ties_and_a_hot_vector(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 700, 2)] + [
        (i, r.normal(size=3).round(1).tolist()) for i in range(1, 700, 2)]
    monkeypatch.setattr(A, "ROWS", 64)
    monkeypatch.setattr(A, "QUERIES", 2)
    found, want = run(spark, rows, parts=1), brute(rows)
    assert {q: [i for _, i in a] for q, a in found.items()} == {q: [i for _, i in a] for q, a in want.items()}


def test_balanced_parts():
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 8)) + 4 * r.integers(0, 4, (1500, 1))
    near = A.neighbours(x, 10)
    part = A.balanced(x, near, 8)
    size = np.bincount(part, minlength=8)
    assert size.max() <= np.ceil(1500 / 8 * 1.05) + 1
    cut = (part[near] != part[:, None]).mean()
    assert cut < 0.6 * (r.permutation(part)[near] != part[:, None]).mean()


def test_repeated_ids_take_one_place():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    ids = np.array([7] * 20 + list(range(100, 140)))
    q = rng.normal(size=(3, 5)) * 0.1 + x[:1]
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    at, found, score = A.nearest(np.array([1, 2, 100]), q, ids, x, 10)
    for k, own in enumerate((1, 2, 100)):
        best = {}
        for i, s in zip(ids.tolist(), d[k]):
            if i != own:
                best[i] = min(s, best.get(i, 9e9))
        assert found[at == k].tolist() == sorted(best, key=lambda i: (best[i], i))[:10]
