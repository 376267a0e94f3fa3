"""Nearest neighbours by learned partitions of a neighbour graph.

The index is fitted on at most about ``bound`` vectors, picked by a hash of the id, on the driver: their
exact neighbour graph is cut into balanced parts (bisection at medians along principal directions, then
moves to the part with most neighbours as room allows), and a small network learns, from a
vector alone, how its neighbours are spread over the parts. Every row of the table is then put into its
most probable part. A query goes to its most probable parts, as many as the fitted vectors
need for ``aim`` of their neighbours (more while those hold too few rows), and is ranked there by exact
Euclidean distance in double precision.

Parts are searched in blocks of at most about ROWS vectors and QUERIES queries, dealt by a hash, so
a part or a vector with very many rows is spread out; of equal vectors in a block, only the
least ids that could be in a result are compared. What leaves a block are k rows a query.

Defined cases: rows with a null id, or a vector that is null, zero or has a null or non-finite
component, take no part, nor do vectors of another length than the most common (ties: the shorter). Rows
repeating id and vector count once; rows of the query's own id are not its candidates; a candidate
id of several vectors counts with its nearest. Ties go to the smaller id. A query id of several vectors is
searched with the least one. An empty table gives an empty table; columns other than id and vector
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drawn, map_batches

ROWS = 16_384
QUERIES = 65_536
#: Distances computed at a time.
CELLS = 1 << 22


def usable(rows: DataFrame, id_col: str, vec_col: str, size: int | None = None) -> DataFrame:
    """(vec_id, v): the rows that take part; ``size`` is the vectors' length (default: any)."""
    v = F.col(vec_col).cast("array<double>")
    good = rows.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    return good if size is None else good.where(F.size("v") == size)


def _matrix(col) -> np.ndarray:
    """(rows, size) of an Arrow column of lists of one size."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


# --- fitting, on a bounded sample -------------------------------------------------


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of every row, by exact search in blocks."""
    n, sq = len(x), (x * x).sum(1)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for lo in range(0, n, 512):
        d = sq[None, :] - 2 * x[lo:lo + 512] @ x.T
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo:lo + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12,
             slack: float = 0.05) -> np.ndarray:
    """A part for every row: of like size, with few neighbours apart."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        at, first, n = todo.pop()
        if n == 1:
            part[at] = first
            continue
        y = x[at] - x[at].mean(0)
        direction = np.random.default_rng(n).normal(size=x.shape[1])
        for _ in range(8):
            direction = y.T @ (y @ direction)
            direction /= np.linalg.norm(direction) + 1e-300
        order = np.argsort(y @ direction, kind="stable")
        half = len(at) * (n // 2) // n
        todo += [(at[order[:half]], first, n // 2), (at[order[half:]], first + n // 2, n - n // 2)]
    room = int(np.ceil(len(x) / parts * (1 + slack)))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        for c in range(near.shape[1]):
            np.add.at(votes, (np.arange(len(x)), part[near[:, c]]), 1)
            np.add.at(votes, (near[:, c], part), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer: vector -> probability of each part."""

    def __init__(self, x: np.ndarray, spread: np.ndarray, hidden: int = 128, epochs: int = 30,
                 batch: int = 256, rate: float = 3e-3):
        r = np.random.default_rng(0)
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        x = (x - self.mean) / self.scale
        shapes = (x.shape[1], hidden), (hidden,), (hidden, spread.shape[1]), (spread.shape[1],)
        self.p = [r.normal(size=s) / np.sqrt(s[0]) if len(s) > 1 else np.zeros(s) for s in shapes]
        m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo:lo + batch]
                h, q = self._run(x[at])
                dq = (q - spread[at]) / len(at)
                dh = dq @ self.p[2].T * (h > 0)
                step += 1
                for i, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ dq, dq.sum(0))):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    self.p[i] -= rate * (m[i] / (1 - 0.9 ** step)) / (
                        np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)

    def _run(self, x):
        h = np.maximum(x @ self.p[0] + self.p[1], 0)
        z = h @ self.p[2] + self.p[3]
        z = np.exp(z - z.max(1, keepdims=True))
        return h, z / z.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._run((x - self.mean) / self.scale)[1]


def fit(x: np.ndarray, parts: int = 32, k: int = 10, aim: float = 0.97) -> tuple[Router | None, int]:
    """(router, parts that a query is sent to). Too few vectors for two parts: no router."""
    x = np.unique(x, axis=0)
    parts = min(parts, len(x) // 64)
    if parts < 2:
        return None, 1
    near = neighbours(x, k)
    part = balanced(x, near, parts)
    spread = np.zeros((len(x), parts))
    np.add.at(spread, (np.arange(len(x)), part), 1)
    for c in range(near.shape[1]):
        np.add.at(spread, (np.arange(len(x)), part[near[:, c]]), 1)
    router = Router(x, spread / spread.sum(1, keepdims=True))
    p = router(x)
    order = np.argsort(-p, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], 1)
    # Where the parts of its neighbours stand in each vector's order.
    at = np.take_along_axis(place, order[:, 0][near], 1)
    found = np.cumsum(np.bincount(at.ravel(), minlength=parts)) / at.size
    return router, int(np.searchsorted(found, aim) + 1)


# --- the search ---------------------------------------------------------------------


def nearest(q_ids, q, ids, x, k: int):
    """(query number, id, distance) of the k nearest rows of a block for each query."""
    order = np.lexsort(ids[None, :])
    ids, x = ids[order], np.ascontiguousarray(x[order]) + 0.0  # no negative zeros
    # Of equal vectors the k + 1 least ids suffice: one may be the query's own.
    _, group = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(),
                         return_inverse=True)
    by = np.lexsort((ids, group))
    new = np.ones(len(by), bool)
    new[1:] = (group[by][1:] != group[by][:-1]) | (ids[by][1:] != ids[by][:-1])
    by = by[new]
    first = np.searchsorted(group[by], group[by])
    keep = by[np.arange(len(by)) - first <= k]
    ids, x = ids[keep], x[keep]
    sq = (x * x).sum(1)
    by_id = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[by_id], prepend=ids[by_id[:1]] - 1))
    first = first if len(first) < len(ids) else None  # none is repeated
    out = []
    for lo in range(0, len(q), max(1, CELLS // max(len(x), 1))):
        part = q[lo:lo + max(1, CELLS // max(len(x), 1))]
        d = sq[None, :] - 2 * part @ x.T + (part * part).sum(1)[:, None]
        own = ids[None, :] == q_ids[lo:lo + len(part), None]
        d[own] = np.inf
        # A repeated id takes one place, with its nearest vector.
        each = d if first is None else np.minimum.reduceat(d[:, by_id], first, axis=1)
        bar = np.partition(each, min(k, each.shape[1]) - 1, axis=1)[:, min(k, each.shape[1]) - 1]
        # Rounding of the quick formula must not decide.
        room = 1e-9 * (1 + (part * part).sum(1) + sq.max(initial=0))
        r, c = np.nonzero((d <= (bar + room)[:, None]) & ~own)
        exact = np.sqrt(((part[r] - x[c]) ** 2).sum(1))
        order = np.lexsort((ids[c], exact, r))
        r, c, exact = r[order], c[order], exact[order]
        if first is not None:
            _, at = np.unique(np.stack([r, ids[c]]), axis=1, return_index=True)
            at.sort()
            r, c, exact = r[at], c[at], exact[at]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[top] + lo, ids[c[top]], exact[top]))
    return [np.concatenate(z) for z in zip(*out)] if out else [np.empty(0, np.int64)] * 3


def search(rows: DataFrame, queries: DataFrame, k: int = 10, parts: int = 32, bound: int = 8_192,
           aim: float = 0.97, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first."""
    spark = rows.sparkSession
    sizes = usable(rows, id_col, vec_col).groupBy(F.size("v").alias("size")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    size, n = (sizes["size"], sizes["n"]) if sizes else (0, 0)
    base, asked = (usable(t, id_col, vec_col, size) for t in (rows, queries))
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))

    some = drawn(bound / max(n, 1), "vec_id")
    sample = [r["v"] for r in base.where(some).select("v").collect()]  # about ``bound`` rows
    model = fit(np.array(sample).reshape(len(sample), -1), parts, k, aim) if sample else (None, 1)
    shipped = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def make_part():
        import pickle

        router, _ = pickle.loads(shipped.value)

        def run(batch):
            part = router(_matrix(batch.column("v"))).argmax(1) if router else np.zeros(batch.num_rows)
            return {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "part": part.astype(int)}

        return run

    base = map_batches(base, make_part, "vec_id long, v array<double>, part int")
    sizes = base.groupBy("part", "vec_id").agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(
        F.count(F.lit(1)).alias("ids"), F.sum("n").alias("n")).collect()
    held, rows_of = ({r["part"]: r[c] for r in sizes} for c in ("ids", "n"))

    def make_route():
        import pickle

        router, probes = pickle.loads(shipped.value)

        def run(batch):
            if router is None:
                to = [[0]] * batch.num_rows
            else:
                order = np.argsort(-router(_matrix(batch.column("v"))), axis=1)
                have = np.cumsum(np.array([held.get(p, 0) for p in range(order.max() + 1)])[order], 1)
                # As many parts as fitted, and more while they can't hold k others.
                least = np.minimum((have <= k).sum(1) + 1, order.shape[1])
                to = [row[:max(probes, m)] for row, m in zip(order, least)]
            return {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "parts": to}

        return run

    asked = map_batches(asked, make_route, "vec_id long, v array<double>, parts array<int>")
    asked = asked.select("vec_id", "v", F.explode("parts").alias("part")).where(
        F.col("part").isin(list(held)))
    wanted = {r["part"]: r["n"] for r in
              asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}

    # Blocks of rows and of queries: numbers a part, as literals.
    def blocks(have: dict, most: int):
        return F.coalesce(F.create_map(*[F.lit(x) for p, m in have.items()
                                         for x in (p, -(-m // most))])[F.col("part")], F.lit(1)) \
            if have else F.lit(1)

    row_blocks, query_blocks = blocks(rows_of, ROWS), blocks(wanted, QUERIES)
    hashed = F.xxhash64("vec_id", "v")
    left = base.withColumn("rb", F.pmod(hashed, row_blocks).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
    right = asked.withColumn("qb", F.pmod(hashed, query_blocks).cast("int")).withColumn(
        "rb", F.explode(F.sequence(F.lit(0), row_blocks - 1)))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        cols = [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        if a.num_rows and b.num_rows:
            (ids, x), (q_ids, q) = (
                (t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks()))
                for t in (a, b))
            at, found, score = nearest(q_ids, q, ids, x, k)
            cols = [q_ids[at], found, score]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()),
                         "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    keys = ("part", "rb", "qb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
