"""Improbable-feature digests of documents.

Features are the WINDOW-byte windows of a text's UTF-8 bytes. A window's entropy, in
1/1000 of the largest, has a rarity rank: how often that value occurs in the whole corpus
(``rarity``, one pass over all documents). Among every RUN consecutive windows the one of the
lowest rank (leftmost on ties) gets a vote; windows of at least VOTES votes, but not of nearly
no entropy, are the improbable features. In order of place, each new one sets BITS bits of a
Bloom filter of M bits; a filter holds FILL features, then the next of the chain begins. Two digests
are compared filter by filter: shared bits beyond those expected by chance, over the most there
could be; every filter of the shorter chain takes its best match, and the likeness is their
mean, weighted by features.

``with_next`` gives each document the next one in descending order of id, without a global
window: ids are cut into ranges at approximate quantiles, the first rows of a range also go to
the one before it, and each range is read through in order.

Defined cases: null texts count as empty; a text without any feature (shorter than the window, or
all of nearly one character) has one, the whole text, and the empty text none: two
empty digests have likeness 1, an empty and another 0; equal texts have equal digests whatever
their ids; rows of one id stand in order of text (null first), null ids come last; the
last document's next is the first, a lone one's itself; an empty table gives an empty table; columns
other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, mix

WINDOW = 64
RUN = 64
VOTES = 16
BITS = 5
M = 2048
FILL = 160
#: Entropies (of 1000) below which a window is no feature.
LOW = 100
#: Bytes worked on together: several texts, or a part of a longer one.
BLOCK = 1 << 18


def _entropy_table() -> np.ndarray:
    """c log2 c in fixed point, so that running sums don't drift."""
    c = np.arange(WINDOW + 1, dtype=float)
    return np.round(c * np.log2(np.maximum(c, 1)) * (1 << 20)).astype(np.int64)


_G = _entropy_table()
_FULL = int(_G[WINDOW])


def entropies(x: np.ndarray) -> np.ndarray:
    """Entropy (0..1000 of the largest) of every window of the bytes ``x``; at least WINDOW of them."""
    n = len(x)
    before = np.zeros(n, np.uint8)  # equal bytes among the WINDOW - 1 before
    after = np.zeros(n, np.uint8)  # and after
    for k in range(1, min(WINDOW, n)):
        same = (x[k:] == x[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    gain = _G[before + 1] - _G[before]
    loss = _G[after + 1] - _G[after]
    total = np.cumsum(gain)[WINDOW - 1:]
    total[1:] -= np.cumsum(loss[:n - WINDOW])
    return ((_FULL - total) * 1000 // _FULL).astype(np.int64)


def _pieces(n: int, lap: int):
    """(from, to) of blocks of BLOCK out of ``n``, with up to ``lap`` more to the right."""
    for a in range(0, n, BLOCK):
        yield a, min(n, a + BLOCK + lap)


def _runs(datas: list[bytes]):
    """Lists of places of texts worked on together: BLOCK bytes or one longer text."""
    part, size = [], 0
    for i, data in enumerate(datas):
        if part and size + len(data) > BLOCK:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(data)
    if part:
        yield part


def _whole(begin: np.ndarray, size: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of ``n`` places begin a stretch of ``width`` inside one text."""
    edge = np.zeros(n + 1, np.int32)
    some = size >= width
    np.add.at(edge, begin[some], 1)
    np.add.at(edge, begin[some] + size[some] - width + 1, -1)
    return np.cumsum(edge[:n]) > 0


def histogram(datas: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy value."""
    out = np.zeros(1001, np.int64)
    for part in _runs(datas):
        size = np.array([len(datas[i]) for i in part])
        x = np.frombuffer(b"".join(datas[i] for i in part), np.uint8)
        begin = np.cumsum(size) - size
        n = len(x) - WINDOW + 1
        if n < 1:
            continue
        inside = _whole(begin, size, n, WINDOW)
        for a, b in _pieces(n, 0):
            e = entropies(x[a:b + WINDOW - 1])
            out += np.bincount(e[inside[a:b]], minlength=1001)
    return out


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank (0: rarest) of each of the 1001 entropy values over all windows of all texts;
    values below LOW and such as never occur come last. 1001 numbers reach the driver."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches):
        total = np.zeros(1001, np.int64)
        for batch in groups(batches, ("text",)):
            total += histogram([x for x in batch.column("text").cast(pa.binary()).to_pylist() if x])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["value", "n"])

    count = np.zeros(1001, np.int64)
    for r in rows.mapInArrow(run, "value long, n long").groupBy("value").agg(
            F.sum("n").alias("n")).collect():
        count[r["value"]] = r["n"]
    count[:LOW] = count.max() + 1
    count[count == 0] = count.max() + 2
    rank = np.empty(1001, np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(1001)
    return rank


def _features(x: np.ndarray, begin: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the improbable windows of the texts that lie end to end in ``x``."""
    n = len(x) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int64)
    votes = np.zeros(n, np.int32)
    low = np.zeros(n, bool)
    inside = _whole(begin, size, n, WINDOW)
    # A run lies in one text; a text of fewer windows than a run is one run by itself.
    runs = _whole(begin, size, n, WINDOW + RUN - 1)
    short = np.flatnonzero((size >= WINDOW) & (size < WINDOW + RUN - 1))
    for a, b in _pieces(n, RUN - 1):
        e = entropies(x[a:b + WINDOW - 1])
        low[a:b] = e < LOW
        key = (np.where(inside[a:b], rank[e], 1 << 20) << 40) + np.arange(a, b)
        best, wide = key, 1
        while 2 * wide <= RUN and len(best) > wide:
            best = np.minimum(best[:-wide], best[wide:])
            wide *= 2
        if wide == RUN:
            best = best[:BLOCK]
            won = (best[runs[a:a + len(best)]] & ((1 << 40) - 1)) - a
            votes[a:b] += np.bincount(won, minlength=b - a).astype(np.int32)
        for t in short[(begin[short] >= a) & (begin[short] + size[short] - WINDOW < b)]:
            own = key[begin[t] - a:begin[t] - a + size[t] - WINDOW + 1]
            votes[begin[t] + own.argmin()] = VOTES
    return np.flatnonzero((votes >= VOTES) & ~low)


def _hashes(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window that begins at ``at``."""
    h = np.zeros(len(at), np.uint64)
    if not len(at):
        return h
    parts = np.lib.stride_tricks.sliding_window_view(x, WINDOW)
    for lo in range(0, len(at), 1 << 16):
        words = np.ascontiguousarray(parts[at[lo:lo + (1 << 16)]]).view(np.uint64)
        g = np.full(len(words), 0x5851F42D4C957F2D, np.uint64)
        with np.errstate(over="ignore"):
            for c in range(words.shape[1]):
                g = mix(g ^ words[:, c]) + np.uint64(c)
        h[lo:lo + (1 << 16)] = g
    return h


def fingerprints(datas: list[bytes], rank: np.ndarray) -> list[bytes]:
    """Each text's chain of filters, M bits a filter; a last byte tells the last filter's features."""
    out = []
    for part in _runs(datas):
        size = np.array([len(datas[i]) for i in part])
        begin = np.cumsum(size) - size
        x = np.frombuffer(b"".join(datas[i] for i in part), np.uint8)
        at = _features(x, begin, size, rank)
        hashes = _hashes(x, at)
        cut = np.searchsorted(at, np.append(begin, len(x)))
        for t, i in enumerate(part):
            out.append(_chain(datas[i], hashes[cut[t]:cut[t + 1]]))
    return out


def _chain(data: bytes, h: np.ndarray) -> bytes:
    if not data:
        return b""
    if len(h):
        _, first = np.unique(h, return_index=True)
        h = h[np.sort(first)]
    else:
        h = np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), "<u8")
    chain = np.arange(len(h)) // FILL
    bits = np.zeros((int(chain[-1]) + 1, M), np.uint8)
    for k in range(BITS):
        bits[chain, (h >> np.uint64(11 * k)).astype(np.int64) % M] = 1
    return np.packbits(bits, axis=1).tobytes() + int(len(h) - FILL * chain[-1]).to_bytes(1, "big")


def likeness(a: bytes, b: bytes) -> float:
    """0 (no more shared bits than by chance) to 1 (the shorter is contained in the longer)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b) or (len(a) == len(b) and a > b):
        a, b = b, a
    u, v = (np.unpackbits(np.frombuffer(s[:-1], np.uint8).reshape(-1, M // 8), axis=1)
            for s in (a, b))
    weight = np.full(len(u), float(FILL))
    weight[-1] = a[-1]
    best = np.zeros(len(u))
    su = u.sum(1, dtype=np.float32)
    for lo in range(0, len(v), 256):
        w = v[lo:lo + 256].astype(np.float32)
        sv = w.sum(1)
        shared = u.astype(np.float32) @ w.T
        chance = su[:, None] * sv / M
        most = np.minimum(su[:, None], sv)
        # The bar lies halfway between chance and all, and at least a third of the bits above
        # chance, as shared rare features in unlike texts exceed pure chance a little.
        bar = chance + 0.3 * (most - chance)
        got = np.clip((shared - bar) / np.maximum(most - bar, 1e-9), 0.0, 1.0)
        best = np.maximum(best, got.max(1))
    return float((best * weight).sum() / weight.sum())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              ranges: int | None = None) -> DataFrame:
    """(range, ahead, doc_id, text): rows dealt out by ranges of descending id. ``ahead`` marks
    the copy of a row that only serves as the next one of the range's last row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100_000)
                    .alias("q")).first()["q"] or []
    cuts = sorted(set(cuts), reverse=True)
    # Range 0 has the largest ids; null ids are after all others.
    where = F.lit(0)
    if cuts:
        where = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c >= F.col("doc_id")))
    where = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(where)
    placed = rows.withColumn("range", where.cast("int"))
    # The top id of every range that has rows: as many rows as ranges.
    top = {r["range"]: r["top"] for r in placed.groupBy("range").agg(F.max("doc_id").alias("top"))
           .collect()}
    full = sorted(top)
    before = {r: full[i - 1] for i, r in enumerate(full)}  # the first range's is the last
    at = F.lit(False)
    for r in full:
        at = at | ((F.col("range") == r) & F.col("doc_id").eqNullSafe(F.lit(top[r])))
    to = F.create_map(*[F.lit(x) for r in full for x in (r, before[r])]) if full else None
    heads = placed.where(at).withColumn("range", to[F.col("range")]) if full else placed.limit(0)
    both = placed.withColumn("ahead", F.lit(False)).unionByName(heads.withColumn("ahead", F.lit(True)))
    return both.repartition(n, "range").sortWithinPartitions(
        "range", "ahead", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()
    ).select("range", "ahead", "doc_id", "text")


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]




def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           ranges: int | None = None) -> DataFrame:
    """A row per document: ``doc_id``, ``n_chars``, ``edited_sha256`` (of the edited text's UTF-8),
    ``fingerprint``, ``edited_fingerprint`` (hex), ``near_edited``, ``near_next``."""
    rank = rarity(docs, text_col)
    dealt = with_next(docs, id_col, text_col, ranges)
    kind = dealt.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(rank))
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = (f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        import pickle

        rank, held = None, None  # held: range, ahead, id and text of the row before
        for batch in groups(batches, ("text",), 1 << 20):
            rank = pickle.loads(shipped.value) if rank is None else rank
            rows = [held] * (held is not None)
            for r, ahead, doc, text in zip(*(batch.column(c).to_pylist() for c in
                                             ("range", "ahead", "doc_id", "text"))):
                if not (rows and rows[-1][:2] == (r, True)):  # of the rows ahead, the first
                    rows.append((r, ahead, doc, text or ""))
            pairs = [(u, v) for u, v in zip(rows, rows[1:]) if u[0] == v[0]]
            held = rows[-1]
            if not pairs:
                continue
            new = [_utf8(edited(u[3], v[3])) for u, v in pairs]
            marks = fingerprints([_utf8(x[3]) for x in rows] + new, rank)
            place = [k for k, (u, v) in enumerate(zip(rows, rows[1:])) if u[0] == v[0]]
            out = []
            for k, (u, _), text, mark in zip(place, pairs, new, marks[len(rows):]):
                was, then = marks[k], marks[k + 1]
                out.append((u[2], len(u[3]), hashlib.sha256(text).hexdigest(), was.hex(),
                            mark.hex(), likeness(was, mark), likeness(was, then)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)
