"""Near duplicates by order minhash, verified by banded alignment.

A text is the sequence of its five-word shingles (words lower-cased; a text of fewer words is
one shingle). Each shingle is labelled with its occurrence number. A sketch has LANES lanes: a
lane hashes the labelled shingles with its own function, takes the PICK smallest and keeps
them in text order, so lanes agree with the similarity of the sets and of the order: an
edit-sensitive minhash. Texts that agree on a lane are candidates.

Lanes can't be trusted with few shingles, so short texts (up to SHORT shingles) have an exact
way besides: the shingles of the texts that can be as like as ``threshold`` to a short one are
counted, and each such text is a candidate by its rarest ones, one more than the edits allowed. Two
texts that are alike share one of these (prefix filtering), so no link of a short text is missed.

Similarity is 1 - edit distance / the longer length, over shingle sequences; pairs of at least
``threshold`` are links. Texts of the same words are one class (its key a hash of the words)
before anything is compared. Candidates aren't expanded into all pairs. In each round, a bucket (a
lane's value, or a rare shingle) whose members are in more than one component so far picks a leader
from its largest component, another one each round, and its members outside that component
are compared with the leader: a comparison a member. Rounds go on until one finds no link (or
ROUNDS are over). The buckets that then still have more than one component are finished exactly,
those of one largest component together: every member outside it is compared with all members outside its
own, in blocks within tasks, and a block returns a spanning forest of the components that it joins, not
its pairs. So no candidate pair that could join two groups stays untested, while a bucket of
near copies, however large, costs a few comparisons a member and gives a link a member at most.
New links join components, not their members (``components.merged``).

A comparison counts shared shingles (fewer than threshold x the longer: no link), then aligns along
shared shingles that stand once in either text (if the gaps cost no more than allowed: a link), and
else aligns what is left between common beginning and end in a band of the allowed distance, many
pairs at a time.

Defined cases: a null text counts as empty; all texts without words are one class; repeated
ids are rows of their own (a row's class depends on its text alone); the group id is the least
non-null id of the group (null if there is none); an empty table gives an empty table; columns other than id
and text are ignored by ``groups_of`` and kept by ``first_of_groups``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, hot_join, map_batches, mix, written
from .components import merged

SHINGLE = 5
LANES = 40
PICK = 5
#: Leader rounds at most, before what is open is finished exactly.
ROUNDS = 3
SIGNS = 4
#: Shingles of a text up to which its candidates are found exactly.
SHORT = 40
_WORD = re.compile(r"\w+")
_SEEDS = mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(_SEEDS) | np.uint64(1)
#: Shingles (and 100 a text) of a block of texts that are compared with another block.
CELLS = 300_000
#: Shingles hashed at a time, so that a very long text needs no more memory.
BLOCK = 1 << 14


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words (of all words, if fewer), given the words' hashes."""
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * np.uint64(0x100000001B3) + h[j:len(h) - k + 1 + j])
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles hashed with their occurrence number."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    at = np.arange(len(t))
    nth = np.empty(len(t), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return s + nth * np.uint64(0xD6E8FEB86659FD93)


def _least(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(LANES, up to PICK) least hashes of each lane in growing order, and their places."""
    with np.errstate(over="ignore"):
        h = (s[None, :] ^ _SEEDS[:, None]) * _FACTORS[:, None]
    if len(s) > 64:
        # The least of n even numbers are nearly always below 24 n-ths of the range.
        lane, at = np.nonzero(h < np.uint64(2 ** 64 / len(s) * 24))
        begin = np.searchsorted(lane, np.arange(LANES + 1))
        if (np.diff(begin) >= PICK).all():
            low = h[lane, at]
            order = np.lexsort((low, lane))[begin[:-1, None] + np.arange(PICK)]
            return low[order], at[order]
    at = np.argsort(h, axis=1, kind="stable")[:, :PICK]
    return np.take_along_axis(h, at, 1), at


def sketch(s: np.ndarray) -> np.ndarray:
    """LANES numbers: each of the PICK least labelled shingles of a lane, in text order."""
    s = labelled(s)
    low, where = _least(s[:BLOCK])
    for lo in range(BLOCK, len(s), BLOCK):
        h, at = _least(s[lo:lo + BLOCK])
        low, where = np.concatenate([low, h], 1), np.concatenate([where, at + lo], 1)
        best = np.argsort(low, axis=1, kind="stable")[:, :PICK]
        low, where = np.take_along_axis(low, best, 1), np.take_along_axis(where, best, 1)
    ordered = np.take_along_axis(low, np.argsort(where, axis=1), 1)
    out = _SEEDS.copy()
    with np.errstate(over="ignore"):
        for j in range(ordered.shape[1]):
            out = mix(out * np.uint64(31) + ordered[:, j])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """SIGNS numbers of 64 bits, of which each labelled shingle sets one: a bit that a text has
    alone tells of a shingle that it has alone."""
    at = (labelled(s) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % (64 * SIGNS)
    bits = np.zeros(64 * SIGNS, np.uint8)
    bits[at] = 1
    return np.packbits(bits).view("<i8")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection."""
    return len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common beginning and end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = differ[0] if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    if n:
        differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
        tail = differ[0] if len(differ) else n
        a, b = a[:len(a) - tail], b[:len(b) - tail]
    return a, b


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], bands: list[int],
              cells: int = 1 << 16) -> np.ndarray:
    """Edit distance of each pair, or something above its band where it exceeds that. Pairs of like
    length and band fill one table, a row of which is worked out for all of them at once."""
    out = np.zeros(len(pairs), np.int64)
    todo = []
    for i, (a, b) in enumerate(pairs):
        a, b = _trimmed(a, b)
        if len(a) < len(b):
            a, b = b, a
        out[i] = len(a)
        if len(b) and len(a) - len(b) <= bands[i]:
            todo.append((min(bands[i], len(a)), len(a), i, a, b))
    todo.sort(key=lambda t: t[:3])
    lo = 0
    while lo < len(todo):
        hi = lo + 1
        while hi < len(todo) and (hi - lo) * (2 * todo[hi][0] + 1) < cells and \
                todo[hi][1] <= 2 * todo[lo][1] + 32 and todo[hi][0] <= 2 * todo[lo][0] + 8:
            hi += 1
        _aligned(todo[lo:hi], out)
        lo = hi
    return out


def _aligned(part: list, out: np.ndarray) -> None:
    """Rows follow ``a``; column c of row i stands for the place i + c - w of ``b``."""
    w = max(t[0] for t in part)
    n = max(t[1] for t in part)
    width, far = 2 * w + 1, 1 << 28
    a = np.zeros((len(part), n), np.uint64)
    b = np.zeros((len(part), n + 2 * w + 2), np.uint64)
    la = np.array([t[1] for t in part])
    lb = np.array([len(t[4]) for t in part])
    for r, t in enumerate(part):
        a[r, :la[r]] = t[3]
        b[r, w + 1:w + 1 + lb[r]] = t[4]  # place j (from 1) is at column w + j
    col = np.arange(width)
    place = col - w
    row = np.where(place >= 0, place, far)[None, :].repeat(len(part), 0).astype(np.int64)
    row[place[None, :] > lb[:, None]] = far
    ends = {}
    for r, m in enumerate(la):
        ends.setdefault(int(m), []).append(r)
    for i in range(1, n + 1):
        place = i + col - w
        diag = row + (a[:, i - 1:i] != b[:, i:i + width])
        up = np.concatenate([row[:, 1:], np.full((len(part), 1), far)], 1) + 1
        row = np.minimum(diag, up)
        bad = (place < 0) | (place > lb[:, None])
        if 0 <= w - i < width:
            row[:, w - i] = i  # place 0: everything of a so far is dropped
        row[bad] = far
        row = np.minimum.accumulate(row - col, axis=1) + col
        row[bad] = far
        for r in ends.get(i, ()):
            c = lb[r] - i + w
            out[part[r][2]] = row[r, c] if 0 <= c < width else far


def anchored(a: np.ndarray, b: np.ndarray) -> int:
    """A cost that an alignment of both has: shingles that stand once in each, as far as they
    stand in the same order, are matched, and what lies between is replaced."""
    ua, ia, na = np.unique(a, return_index=True, return_counts=True)
    ub, ib, nb = np.unique(b, return_index=True, return_counts=True)
    _, x, y = np.intersect1d(ua[na == 1], ub[nb == 1], assume_unique=True, return_indices=True)
    i, j = ia[na == 1][x], ib[nb == 1][y]
    order = np.argsort(i)
    i, j = i[order], j[order]
    # Kept are anchors behind all before and ahead of all after them: one order for both.
    if len(j):
        ok = (j >= np.maximum.accumulate(j)) & (j <= np.minimum.accumulate(j[::-1])[::-1])
        i, j = i[ok], j[ok]
    gap_a = np.diff(np.concatenate([[-1], i, [len(a)]])) - 1
    gap_b = np.diff(np.concatenate([[-1], j, [len(b)]])) - 1
    return int(np.maximum(gap_a, gap_b).sum())


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """Which pairs of shingle sequences are at least ``threshold`` alike."""
    yes = np.zeros(len(pairs), bool)
    left = []
    for i, (a, b) in enumerate(pairs):
        most = max(len(a), len(b))
        allowed = int(np.floor((1 - threshold) * most + 1e-9))
        if not most:
            yes[i] = True
        elif most - min(len(a), len(b)) <= allowed and most - shared(a, b) <= allowed:
            if anchored(a, b) <= allowed:
                yes[i] = True
            else:
                left.append((i, allowed))
    narrow = 16
    while left:
        bands = [min(w, narrow) for _, w in left]
        d = distances([pairs[i] for i, _ in left], bands)
        again = []
        for (i, w), band, x in zip(left, bands, d):
            if x <= band:
                yes[i] = True
            elif band < w:
                again.append((i, w))
        left, narrow = again, narrow * 8
    return yes


def _sketches(docs: DataFrame, id_col: str, text_col: str, few: int) -> DataFrame:
    """(doc_id, mark, key, n, lanes, grams, signs) per row; ``mark`` is a hash of the text as it
    stands. Texts up to PICK shingles have no lanes (they would hash all of the text), those up to ``few``
    all labelled shingles."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        words = WordHashes()

        def run(batch):
            key, n, lanes, grams, signs = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                w = words_of(text)
                key.append(hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"),
                                           digest_size=16).digest())
                s = shingles(words.of(w))
                n.append(len(s))
                lanes.append(sketch(s).view(np.int64) if len(s) > PICK else [])
                grams.append(labelled(s).view(np.int64) if len(s) <= few else [])
                signs.append(signature(s))
            return {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "key": key,
                    "n": n, "lanes": lanes, "grams": grams, "signs": signs}

        return run

    return map_batches(rows, make, f"doc_id {kind}, mark long, key binary, n long, "
                                   "lanes array<bigint>, grams array<bigint>, signs array<bigint>",
                       ("text",))


def _rarest(first: DataFrame, threshold: float) -> DataFrame:
    """(key, n, bucket): the rarest labelled shingles of the texts that have ``grams``, one more
    than a link may leave unmatched. Those that no other text has are no buckets."""

    def allowed(n):
        return F.floor((1 - threshold) * n + 1e-9).cast("int")

    # A text of which not even one more shingle may differ is like its own class only.
    each = first.where(allowed(F.col("n") + 1) > 0).select("key", "n", F.explode("grams").alias("gram"))
    each = written(each, "grams")
    times = each.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    least = hot_join(each, times, "gram").groupBy("key", "n").agg(
        F.array_sort(F.collect_list(F.struct("times", "gram"))).alias("grams"))
    return least.select("key", "n", F.explode(F.slice("grams", F.lit(1), allowed(F.col("n")) + 1))
                        .alias("gram")).where("gram.times > 1").select(
        "key", "n", F.col("gram.gram").alias("bucket"))


def _linked(pairs: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """Those of the (a, b) pairs of keys whose sequences (key, seq) are alike."""
    for side in ("b", "a"):  # a leader stands in as many pairs as its bucket has members
        pairs = hot_join(pairs, sequences.select(F.col("key").alias(side), F.col("seq").alias(f"seq_{side}")),
                         side)

    def make():
        def run(batch):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            seqs = [(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(
                batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist())]
            yes = similar(seqs, threshold)
            return {"a": [x for x, y in zip(a, yes) if y], "b": [x for x, y in zip(b, yes) if y]}

        return run

    return map_batches(pairs.select("a", "b", "seq_a", "seq_b"), make, "a binary, b binary",
                       ("seq_a", "seq_b"))


def _sequences(docs: DataFrame, first: DataFrame, keys: DataFrame, id_col: str,
               text_col: str) -> DataFrame:
    """(key, seq) of the classes in ``keys``: the shingles of each, from its first row's text."""
    wanted = first.join(keys, "key", "left_semi").select("key", "doc_id", "mark")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("_mark", F.xxhash64("text"))
    got = rows.join(wanted, (rows["_mark"] == wanted["mark"]) & rows["_id"].eqNullSafe(wanted["doc_id"]))

    def make():
        words = WordHashes()

        def run(batch):
            return {"key": batch.column("key"),
                    "seq": [shingles(words.of(words_of(t))).astype("<u8").tobytes()
                            for t in batch.column("text").to_pylist()]}

        return run

    # Rows that repeat id and text would repeat the class.
    return map_batches(got.select("key", "text"), make, "key binary, seq binary",
                       ("text",)).dropDuplicates(["key"])


def _open(member: DataFrame, labels: DataFrame | None, turn: int, carried: list[str]) -> DataFrame:
    """(key, n, label, main, lead, ...) of the buckets in more than one component; ``main`` is the bucket's
    largest (ties: greatest label), ``lead`` one of its members, another one each turn."""
    placed = member.withColumn("label", F.col("key")) if labels is None else member.join(
        labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "label", F.coalesce("label", "key"))
    placed = placed if labels is None else written(placed, "placed")
    parts = placed.groupBy("bucket", "label").agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.struct(F.xxhash64(F.lit(turn), "key").alias("draw"), "key", "n", *carried)).alias("lead"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("size", "label", "lead")).alias("most"),
                                       F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return written(hot_join(placed, main.select("bucket", F.col("most.label").alias("main"),
                                                F.col("most.lead").alias("lead")), "bucket"), "open")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): (doc_id, mark, key) of every row, and (node, label) of the linked classes."""
    few = int(SHORT / threshold + 1e-6)  # the longest that can be like a short one
    sketched = written(_sketches(docs, id_col, text_col, few), "sketches")
    first = written(sketched.groupBy("key").agg(
        F.min(F.struct("doc_id", "mark")).alias("row"), F.first("n").alias("n"),
        F.first("lanes").alias("lanes"), F.first("grams").alias("grams"),
        F.first("signs").alias("signs"))
        .select("key", "row.doc_id", "row.mark", "n", "lanes", "grams",
                *[F.col("signs")[k].alias(f"sign{k}") for k in range(SIGNS)]), "classes")
    signs = [f"sign{k}" for k in range(SIGNS)]

    def near(one: str, other: str):
        """Whether two rows' lengths and signatures allow a link. Each bit that one has alone
        is a shingle that can't be matched."""
        n, m = F.col(f"{one}n"), F.col(f"{other}n")
        allowed = (1 - threshold) * F.greatest(n, m) + 1e-6
        alone = [sum((F.bit_count(F.col(f"{x}{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}{c}"))))
                      for c in signs), F.lit(0)) for x, y in ((one, other), (other, one))]
        return (F.abs(n - m) <= allowed) & (alone[0] <= allowed) & (alone[1] <= allowed)

    # Buckets of more than one class.
    member = written(first.select("key", "n", F.explode("lanes").alias("bucket")).unionByName(
        _rarest(first, threshold)), "members")
    many = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = member.join(many.select("bucket"), "bucket", "left_semi")
    member = written(member.join(first.select("key", *signs), "key"), "buckets")
    sequences = written(_sequences(docs, first, member.select("key").distinct(), id_col, text_col),
                        "sequences")
    tested = labels = None
    for turn in range(ROUNDS):
        # Components only grow: a bucket of one component stays so.
        open_ = _open(member, labels, turn, signs)
        member = open_.select("bucket", "key", "n", *signs)
        pairs = (open_.where("label <> main").where(near("", "lead."))
                 .select(F.least("key", "lead.key").alias("a"), F.greatest("key", "lead.key").alias("b"))
                 .distinct())
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = written(_linked(pairs, sequences, threshold), "links")
        if labels is not None and not found.limit(1).count():
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = merged(labels, found)

    more = _finished(_open(member, labels, ROUNDS, signs), sequences, threshold)
    return sketched.select("doc_id", "mark", "key"), merged(labels, more)


def _finished(open_: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """Links that join components that share a bucket, exactly. The buckets of one largest component
    are a family; its members outside that component are compared, block by block, with all its
    members. Blocks hold about CELLS shingles, so a family of any size is spread out, and each
    returns a spanning forest."""
    kin = open_.select("main", "key", "label", "n").distinct()
    size = kin.groupBy("main").agg(
        F.ceil(F.sum(F.when(F.col("label") != F.col("main"), F.col("n") + 100)) / CELLS).cast("int").alias("rows"),
        F.ceil(F.sum(F.col("n") + 100) / CELLS).cast("int").alias("columns"))
    kin = written(hot_join(written(kin, "family"), size, "main"), "kin")
    whole = kin.join(sequences, "key")

    def dealt(rows, own: str, of: str, other: str, times: str, side: str):
        rows = rows.withColumn(own, F.pmod(F.xxhash64("key"), F.col(of)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
        return rows.select(*[F.col(c).alias(f"{side}_{c}") for c in (*keys, "key", "label", "seq")])

    keys = ("main", "row", "column")

    minor = dealt(whole.where("label <> main"), "row", "rows", "column", "columns", "a")
    every = dealt(whole, "column", "columns", "row", "rows", "b")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            (ka, la, a), (kb, lb, b) = (
                (t.column(f"{side}_key").to_pylist(), t.column(f"{side}_label").to_pylist(),
                 [np.frombuffer(x, "<u8") for x in t.column(f"{side}_seq").to_pylist()])
                for t, side in ((left, "a"), (right, "b")))
            found = [(ka[i], kb[j]) for i, j in forest(la, a, lb, b, threshold)]
        return pa.table({"a": pa.array([min(x) for x in found], pa.binary()),
                         "b": pa.array([max(x) for x in found], pa.binary())})

    found = minor.groupBy(*[f"a_{c}" for c in keys]).cogroup(every.groupBy(*[f"b_{c}" for c in keys])).applyInArrow(run, "a binary, b binary")
    return written(found, "links")


def forest(la: list, a: list[np.ndarray], lb: list, b: list[np.ndarray], threshold: float,
           step: int = 512) -> list[tuple[int, int]]:
    """Links (place in a, place in b) that join the components with labels ``la`` and ``lb`` as all alike
    pairs would, one link a join. Pairs of which both are in one component by now aren't compared."""
    number = {x: k for k, x in enumerate(dict.fromkeys([*la, *lb]))}
    root = np.arange(len(number))  # of each label; kept flat
    na, nb = (np.array([number[x] for x in part]) for part in (la, lb))
    i, j = np.nonzero((na[:, None] != nb[None, :]) & _possible(a, b, threshold))
    # The pairs of one row aren't neighbours, so that early links spare many others.
    order = np.argsort(mix(np.arange(len(i), dtype=np.uint64)))
    i, j = i[order], j[order]
    out = []
    while len(i):
        now, i = i[:step], i[step:]
        then, j = j[:step], j[step:]
        yes = similar([(a[x], b[y]) for x, y in zip(now, then)], threshold)
        for x, y in zip(now[yes], then[yes]):
            p, q = root[na[x]], root[nb[y]]
            if p != q:
                root[root == q] = p
                out.append((int(x), int(y)))
        apart = root[na[i]] != root[nb[j]]
        i, j = i[apart], j[apart]
    return out


def _possible(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """(a, b) whether two sequences share as many labelled shingles as a link needs: counts by
    products of 0/1 matrices over the shingles that occur on both sides."""
    x, y = ([labelled(s) for s in part] for part in (a, b))
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    n, m = (np.array([len(s) for s in part]) for part in (a, b))
    most = np.maximum(n[:, None], m[None, :])
    allowed = np.floor((1 - threshold) * most + 1e-9)

    def places(part):
        row = np.repeat(np.arange(len(part)), [len(s) for s in part])
        s = np.concatenate(part)
        at = np.minimum(np.searchsorted(both, s), max(len(both) - 1, 0))
        ok = both[at] == s if len(both) else np.zeros(len(s), bool)
        return row[ok], at[ok]

    (ra, ca), (rb, cb) = places(x), places(y)
    count = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(both), 4096):
        u, v = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        for z, r, c in ((u, ra, ca), (v, rb, cb)):
            here = (c >= lo) & (c < lo + 4096)
            z[r[here], c[here] - lo] = 1
        count += u @ v.T
    return (np.abs(n[:, None] - m[None, :]) <= allowed) & (most - count <= allowed)


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = 0.8) -> DataFrame:
    """(doc_id, mark, group_id, first) per row: the least id of its group of near duplicates, and
    whether the row is the group's first (by id, nulls last, then by its text's hash)."""
    rows, labels = classes(docs, id_col, text_col, threshold)
    placed = rows.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "doc_id", "mark", F.coalesce("label", "key").alias("label"))
    placed = written(placed, "groups")
    heads = placed.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("head"))
    return hot_join(placed, heads, "label").select(
        "doc_id", "mark", F.col("head.doc_id").alias("group_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
         & F.col("mark").eqNullSafe(F.col("head.mark"))).alias("first"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.8) -> DataFrame:
    """The documents that stand first in their group, all columns kept. Of rows that repeat the
    first one's id and text, one stays."""
    keep = written(groups_of(docs, id_col, text_col, threshold).where("first").groupBy(
        F.col("doc_id").alias("_keep_id"), F.col("mark").alias("_keep_mark")).agg(
        F.count(F.lit(1)).alias("rows")), "kept")
    marked = docs.withColumn("_keep_row_mark", F.xxhash64(docs[text_col].cast("string")))
    out = marked.join(keep.drop("rows"), F.col("_keep_mark").eqNullSafe(F.col("_keep_row_mark"))
                      & F.col("_keep_id").eqNullSafe(docs[id_col]), "left_semi")
    if keep.where("rows > 1").limit(1).count():  # else there is nothing to drop
        out = out.dropDuplicates([id_col, "_keep_row_mark"])
    return out.drop("_keep_row_mark")
