"""Hard negatives by bounds along a spanning tree of the anchors.

Rows are vectors of whole numbers with a label; a row's score for an anchor is their inner product. An
anchor's positives are its best other rows of the same label; a positive of score p asks for the best
rows of other labels with a score from ``low`` to ``high`` percent of p, its window.

The anchors are dealt to groups of about GROUP, and a minimum spanning tree by Euclidean distance is
laid through each group once. Groups of anchors meet chunks of rows in cells, a task's
work of bounded size. In a cell, the root's scores are worked out and the tree is walked down layer by
layer: |<child, x> - <parent, x>| is at most the edge's length times the norm of x, so what is known
of a parent's score, widened by that, bounds the child's. Only rows whose bounds overlap what is
looked for are scored anew (first: at least the last of the best so far of the same label; then: the
windows of the anchor, from the third best so far of each); of the others the bounds go on
to the next layer. Equal anchors have edges of length 0 and share their scores. Bounds hold for
every pair, so the result is exact whatever the data; how much they save depends on how
close the anchors lie. Each cell returns its best few an anchor (a window), which are ranked together.

All sums are exact: floats where the norms prove that 53 bits hold them, else 64-bit integers.

Defined cases: a row with a null id, label or vector, or a component that is null or not finite, takes no
part, nor does one whose norm (times the scale) is 2^31 or more, as scores must fit 64 bits.
Vectors of different length are compared as if the shorter one ended in zeros; an empty one scores 0.
Of rows that repeat an id one counts, the least by label, then vector. Ties go to the smaller id. A
positive of negative score has no window (its bounds are crossed). Fewer rows than asked for: all that
there are; an empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Anchors of a group, about: the work of one tree.
GROUP = 1024
#: Numbers of a chunk of rows.
CHUNK = 1 << 21
#: Rows of a chunk that walk the tree together.
BLOCK = 1024
#: Anchors of a layer that are bounded together.
WIDTH = 64
_NONE = np.iinfo(np.int64).min + 1  # which can be negated


def vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vec) of the rows that take part, components as floor(scale * x)."""
    x = F.col("_x")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("_x"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("double"))
    norm = F.aggregate("_w", F.lit(0.0), lambda s, c: s + c * c)
    rows = rows.select("id", "label", whole.alias("_w")).where(norm < float(2 ** 62))
    rows = written(rows.select("id", "label", F.col("_w").cast("array<int>").alias("vec")), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).first()
    if size.n == size.ids:
        return rows
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row"))
    return written(one.select("id", "row.label", "row.vec"), "vectors")


def _matrix(col, dim: int) -> np.ndarray:
    """Rows of a list column as an integer matrix, short ones ended by zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(n), dim), np.int64)
    out[np.arange(dim)[None, :] < n[:, None]] = col.flatten().to_numpy()
    return out


def spanning_tree(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge) of a minimum spanning tree rooted at row 0, grown a nearest row at a time; a
    parent stands before its children in the order of growth, which ``layers`` restores."""
    m = len(a)
    parent, edge = np.zeros(m, np.int64), np.zeros(m)
    near, by, out = np.full(m, np.inf), np.zeros(m, np.int64), np.ones(m, bool)
    last, out[0] = 0, False
    for _ in range(m - 1):
        d = (a - a[last]).astype(np.float64)
        d = np.einsum("ij,ij->i", d, d)
        closer = out & (d < near)
        near[closer], by[closer] = d[closer], last
        last = int(np.argmin(np.where(out, near, np.inf)))
        parent[last], edge[last], out[last] = by[last], np.sqrt(near[last]) * (1 + 1e-9), False
    return parent, edge


def layers(parent: np.ndarray) -> list[np.ndarray]:
    """Rows by their depth in the tree, the root first."""
    found, below = [np.array([0])], np.arange(len(parent)) > 0
    while True:
        here = np.flatnonzero(below & np.isin(parent, found[-1]))
        if not len(here):
            return found
        found.append(here)
        below[here] = False


def first_k(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each row by score, then smaller id, in that order."""
    order = np.lexsort((ident, -score, row))
    r = row[order]
    begin = np.searchsorted(r, r)
    return order[np.arange(len(r)) - begin < k]


class Best:
    """The best k (score, id) so far of each of m rows."""

    def __init__(self, m: int, k: int):
        self.k = k
        self.score = np.full((m, k), _NONE)
        self.ident = np.zeros((m, k), np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        ok = score >= self.score[row, -1]
        row, score, ident = row[ok], score[ok], ident[ok]
        if not len(row):
            return
        rows = np.unique(row)
        old_row = np.repeat(rows, self.k)
        r = np.concatenate([old_row, row])
        s = np.concatenate([self.score[rows].ravel(), score])
        i = np.concatenate([self.ident[rows].ravel(), ident])
        # Unfilled places come last: no score is as low.
        at = first_k(r, s, i, self.k)
        self.score[rows] = s[at].reshape(len(rows), self.k)
        self.ident[rows] = i[at].reshape(len(rows), self.k)

    def rows(self):
        """(row, score, id) of all places that are filled."""
        row, col = np.nonzero(self.score != _NONE)
        return row, self.score[row, col], self.ident[row, col]


def walk(a, parent, edge, x, wanted, take, block: int = BLOCK) -> int:
    """Walks the tree over the rows ``x``, a block at a time. ``wanted(anchors, lo, hi, rows)`` says
    which pairs' bounds overlap what is looked for, ``take(anchor, row, score)`` gets their exact
    scores. Returns how many pairs were scored."""
    high = [np.sqrt((m.astype(np.float64) ** 2).sum(1)) for m in (a, x)]
    exact = max(high[0], default=0) * max(high[1], default=0) < 2.0 ** 52
    kind, slack = (np.float64, 0.0) if exact else (np.int64, 2.0 ** -40)
    a, x, norm = a.astype(kind), x.astype(kind), high[1] * (1 + 1e-9)
    levels = [part for level in layers(parent) for part in np.array_split(level, -(-len(level) // WIDTH))]
    scored = 0
    for at in range(0, len(x), block):
        rows = np.arange(at, min(at + block, len(x)))
        here = x[rows]
        lo, hi = np.empty((len(a), len(rows))), np.empty((len(a), len(rows)))
        for level in levels:
            if level[0] == 0:
                low, top = np.full((1, len(rows)), -np.inf), np.full((1, len(rows)), np.inf)
            else:
                far = edge[level][:, None] * norm[rows][None, :]
                low, top = lo[parent[level]] - far, hi[parent[level]] + far
            ask = wanted(level, low, top, rows)
            if level[0] == 0 or ask.mean() > 0.2:  # a product of matrices costs less than picking
                s = a[level] @ here.T
                i, j = np.nonzero(ask)
                got = s[i, j]
                off = slack * np.abs(s)
                low, top = s - off, s + off
                scored += s.size
            else:
                i, j = np.nonzero(ask)
                got = np.einsum("ij,ij->i", a[level[i]], here[j])
                off = slack * np.abs(got)
                low[i, j], top[i, j] = got - off, got + off
                scored += len(got)
            lo[level], hi[level] = low, top
            if len(i):
                take(level[i], rows[j], got.astype(np.int64))
    return scored


def _trees(anchors: DataFrame, n_groups: int, dim: int) -> DataFrame:
    """(grp, place, id, label, vec, parent, edge) of the anchors, a tree a group."""
    dealt = anchors.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(n_groups)).cast("int"))

    def lay(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        parent, edge = spanning_tree(_matrix(t["vec"], dim))
        for name, col in (("place", np.arange(len(parent))), ("parent", parent), ("edge", edge)):
            t = t.append_column(name, pa.array(col))
        return t.select(["grp", "place", "id", "label", "vec", "parent", "edge"])

    return written(dealt.groupBy("grp").applyInArrow(
        lay, "grp int, place long, id long, label long, vec array<int>, parent long, edge double"), "trees")


def _cells(trees: DataFrame, rows: DataFrame, n_groups: int, n_chunks: int, dim: int, work, schema: str):
    """``work(tree table, anchors, rows table, vectors)`` in every cell."""
    x = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_chunks)).cast("int")).withColumn(
        "grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    a = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            left = left.sort_by("place")
            return work(left, _matrix(left["vec"], dim), right, _matrix(right["vec"], dim))
        return empty

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema).empty_table()
    return a.groupBy("grp", "chunk").cogroup(x.groupBy("grp", "chunk")).applyInArrow(run, schema)


def _first(rows: DataFrame, by: list[str], score: str, ident: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(ident))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _same_label(k: int):
    def work(tree, a, rows, x):
        n = {c: tree[c].to_numpy() for c in ("id", "label", "parent", "edge")}
        ident, label = rows["id"].to_numpy(), rows["label"].to_numpy()
        best = Best(len(a), k)

        def wanted(level, low, top, at):
            return ((n["label"][level][:, None] == label[at][None, :])
                    & (n["id"][level][:, None] != ident[at][None, :])
                    & (top >= best.score[level, -1][:, None]))

        walk(a, n["parent"], n["edge"], x, wanted, lambda i, j, s: best.add(i, s, ident[j]))
        row, score, other = best.rows()
        return pa.table({"anchor_id": n["id"][row], "positive_id": other, "positive_score": score})

    return work


def _in_windows(k: int, most: int):
    def work(tree, a, rows, x):
        n = {c: tree[c].to_numpy() for c in ("id", "label", "parent", "edge")}
        ident, label = rows["id"].to_numpy(), rows["label"].to_numpy()
        # An unused window is above every score.
        lo = np.full((most, len(a)), np.iinfo(np.int64).max)
        hi, pos, score = (np.full((most, len(a)), _NONE) for _ in range(3))
        for i, ws in enumerate(tree["windows"].to_pylist()):
            for w, p in enumerate(ws or ()):
                pos[w, i], score[w, i], lo[w, i], hi[w, i] = p["id"], p["score"], p["lo"], p["hi"]
        best = [Best(len(a), k) for _ in range(most)]
        high = hi.max(0)

        def floors(level):
            """The least score that any window of the anchors still looks for."""
            return np.min([np.maximum(lo[w][level], best[w].score[level, -1]) for w in range(most)], axis=0)

        def wanted(level, low, top, at):
            return ((n["label"][level][:, None] != label[at][None, :])
                    & (top >= floors(level)[:, None]) & (low <= high[level][:, None]))

        def take(i, j, s):
            ok = (s >= floors(i)) & (s <= high[i])
            i, j, s = i[ok], j[ok], s[ok]
            for w in range(most):
                ok = (s >= lo[w][i]) & (s <= hi[w][i])
                best[w].add(i[ok], s[ok], ident[j[ok]])

        walk(a, n["parent"], n["edge"], x, wanted, take)
        out = [[] for _ in range(5)]
        for w in range(most):
            row, s, other = best[w].rows()
            for col, more in zip(out, (n["id"][row], pos[w][row], score[w][row], other, s)):
                col.append(more)
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score", "negative_id",
                                  "negative_score"), map(np.concatenate, out))))

    return work


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50,
         high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which
    ``is_anchor``, a condition on the column ``id``, holds."""
    spark = rows.sparkSession
    good = vectors(rows, id_col, vector_col, label_col, scale)
    size = good.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors"),
                    F.max(F.size("vec")).alias("dim")).first()
    dim = size.dim or 0
    n_groups = max(1, -(-size.anchors // GROUP))
    by_size = -(-size.n * max(dim, 1) // CHUNK)
    # Small tables are dealt to as many tasks as run at once, not finer than 1,024 rows.
    n_chunks = max(1, by_size, min(spark.sparkContext.defaultParallelism, size.n // 1024))
    trees = _trees(good.where(is_anchor), n_groups, dim)
    found = _cells(trees, good, n_groups, n_chunks, dim, _same_label(positives),
                   "anchor_id long, positive_id long, positive_score long")
    best = written(_first(found, ["anchor_id"], "positive_score", "positive_id", positives), "positives")

    p = F.col("positive_score").cast("decimal(20,0)")
    window = best.withColumn("p", p).where("p >= 0").select(
        F.col("anchor_id").alias("id"), F.struct(
            F.col("positive_id").alias("id"), F.col("positive_score").alias("score"),
            F.expr(f"(p * {low} + 99) div 100").alias("lo"), F.expr(f"(p * {high}) div 100").alias("hi"))
        .alias("window")).where("window.lo <= window.hi")
    windows = window.groupBy("id").agg(F.collect_list("window").alias("windows"))
    found = _cells(trees.join(windows, "id", "left"), good, n_groups, n_chunks, dim,
                   _in_windows(negatives, positives),
                   "anchor_id long, positive_id long, positive_score long, negative_id long, "
                   "negative_score long")
    ranked = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
