"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary file's pieces and their order are used; the text is taken as it is (spaces as the
mark, one mark in front) and cut before every run of marks: no piece goes on past one,
so chunks are independent. Within a chunk, the agenda of candidate merges (two neighbouring
symbols whose concatenation is a piece) is worked off best piece first, leftmost first on
ties. A candidate is skipped, for good, if a hash keyed with the seed, the variant, the
chunk's text, its place and its piece falls below the dropout rate. A symbol that is no
piece is written as byte pieces. So a rate of 0 gives the library's own encoding, each seed gives
other segmentations, and every one decodes to the same text.

Documents are dealt ``variants`` variants by a hash of their id: one chunk is segmented in at most so many
ways within a seed, and its encoding can be remembered. Many chunks are worked on together
in numpy; one of more than LONG symbols has a heap for its agenda.

Defined cases: null texts count as empty, and encode to no ids; the mark itself in a text is
written as bytes, so it is not mistaken for a space; repeated rows repeat their result; an
empty table gives an empty table; columns other than id and text are ignored, whatever their
names.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix

MARK = "▁"
LONG = 48
#: Stands for a mark that is the text's own: a lone surrogate, which no stored text holds.
_HELD = "\udc81"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    """Pieces of a model file: number of each, merges, byte pieces."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n)
                 if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.number = {self.pieces[i]: i for i in plain}
        # The rank of a piece is its place in order of score: the lower the better.
        order = sorted(plain, key=lambda i: (-self.score[i], i))
        self.rank = np.full(n, len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.of_rank = np.array(order, np.int32)
        pairs = [(self.number[p[:k]] * n + self.number[p[k:]], i)
                 for p, i in self.number.items() for k in range(1, len(p))
                 if p[:k] in self.number and p[k:] in self.number]
        pairs.sort()
        self.pair_key = np.array([k for k, _ in pairs], np.int64)
        self.pair_rank = np.array([self.rank[i] for _, i in pairs], np.int32)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that two symbols make, or the number of pieces. Symbols that are no
        piece are negative."""
        key = np.where((left < 0) | (right < 0), -1, left * np.int64(len(self.pieces)) + right)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], np.int32(len(self.pieces)))


def chunks(text: str) -> list[str]:
    """The independent parts of a text, spaces written as marks."""
    return _CHUNK.findall(MARK + text.replace(MARK, _HELD).replace(" ", MARK)) if text else []


def _dropped(key, start, rank, limit):
    """Whether the candidate of a chunk (its key), at ``start``, for the piece of ``rank`` is skipped."""
    with np.errstate(over="ignore"):
        h = mix(key ^ (start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                       + rank.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return (h >> np.uint64(11)).astype(np.float64) < limit * 2.0 ** 53


def by_heap(symbols: list[int], key: np.uint64, vocab: Vocabulary, rate: float) -> list[int]:
    """The symbols that are left of one chunk, by an agenda."""
    n, none = len(symbols), len(vocab.pieces)
    sym, nxt, prev = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    one = np.array

    def candidate(i):
        j = nxt[i]
        if j >= n:
            return
        r = int(vocab.merge(one([sym[i]]), one([sym[j]]))[0])
        if r < none and not (rate and _dropped(key, one([i]), one([r]), rate)[0]):
            heapq.heappush(agenda, (r, i, sym[i], sym[j]))

    agenda: list = []
    ranks = vocab.merge(np.array(sym[:-1]), np.array(sym[1:])) if n > 1 else np.empty(0, np.int64)
    at = np.flatnonzero(ranks < none)
    if rate and len(at):
        at = at[~_dropped(key, at, ranks[at], rate)]
    for i in at:
        agenda.append((int(ranks[i]), int(i), sym[i], sym[i + 1]))
    heapq.heapify(agenda)
    while agenda:
        r, i, left, right = heapq.heappop(agenda)
        j = nxt[i]
        if sym[i] != left or j >= n or sym[j] != right or sym[i] is None:
            continue
        sym[i], sym[j] = int(vocab.of_rank[r]), None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        candidate(i)
        if prev[i] >= 0:
            candidate(prev[i])
    return [s for s in sym if s is not None]


def together(rows: np.ndarray, size: np.ndarray, keys: np.ndarray, vocab: Vocabulary,
             rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Many chunks: ``rows`` holds their symbols, ``size`` how many. Each round merges the best
    candidate of every chunk that has one left. Gives the symbols left and their number; a symbol
    that was merged away is gone, the others keep their order."""
    none = len(vocab.pieces)
    w, n = rows.shape
    sym, size = rows.astype(np.int32), size.copy()
    start = np.broadcast_to(np.arange(n, dtype=np.int32), rows.shape).copy()
    rank = np.full((w, n), none, np.int32)

    def ranked(r, c):
        """Rank of the merge at column c of row r; none where it is skipped or there's none."""
        inside = (c >= 0) & (c + 1 < size[r])
        c0 = np.where(inside, c, 0)
        got = np.where(inside, vocab.merge(sym[r, c0], sym[r, np.minimum(c0 + 1, n - 1)]), none)
        if rate:
            some = np.flatnonzero(got < none)
            out = _dropped(keys[r[some]], start[r[some], c0[some]], got[some], rate)
            got[some[out]] = none
        return got

    every = np.repeat(np.arange(w), n), np.tile(np.arange(n), w)
    rank[:] = ranked(*every).reshape(w, n)
    live = np.arange(w)
    columns = np.arange(n)
    while len(live):
        part = rank[live]
        c = part.argmin(1)
        best = part[np.arange(len(live)), c]
        go = best < none
        live, c, best = live[go], c[go], best[go]
        if not len(live):
            break
        sym[live, c] = vocab.of_rank[best]
        # Columns right of the merge move one to the left.
        take = np.minimum(columns + (columns[None, :] > c[:, None]), n - 1)
        for x in (sym, start, rank):
            x[live] = np.take_along_axis(x[live], take, 1)
        size[live] -= 1
        rank[live, c] = ranked(live, c)
        left = c > 0
        rank[live[left], c[left] - 1] = ranked(live[left], c[left] - 1)
        rank[live, np.minimum(size[live], n - 1)] = none
    return sym, size


class Encoder:
    """text -> ids, with chunks remembered up to a bound."""

    def __init__(self, vocab: Vocabulary, seed: int = 0, rate: float = 0.0, bound: int = 200_000):
        self.vocab, self.seed, self.rate, self.bound = vocab, seed, rate, bound
        # Symbol of each code point: its piece, or minus the code point, minus 1.
        self.symbol = -1 - np.arange(0x110000, dtype=np.int64)
        for c, i in vocab.number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.symbol[ord(_HELD)] = -1 - ord(MARK)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, dict[str, int]] = {}  # by variant: chunk -> place in ``end``
        self.flat = np.empty(0, np.int32)
        self.end = np.zeros(1, np.int64)

    def _learn(self, new: list[str], variant: int) -> None:
        cp = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, new), np.int64, len(new))
        begin = np.cumsum(size) - size
        place = np.arange(len(cp)) - np.repeat(begin, size)
        symbols = self.symbol[cp]
        with np.errstate(over="ignore"):
            own = mix(cp.astype(np.uint64) + (place + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            keys = mix(np.add.reduceat(own, begin) + np.uint64(variant % (1 << 32)) * np.uint64(0x9E3779B97F4A7C15)
                       ^ mix(np.array([self.seed % (1 << 64)], np.uint64)))
        left = np.full(len(cp), -1, np.int64)  # the symbols that stay, each chunk's from its begin on
        count = np.zeros(len(new), np.int64)
        for i in np.flatnonzero(size > LONG):
            own = symbols[begin[i]:begin[i] + size[i]]
            got = by_heap(own.tolist(), keys[i], self.vocab, self.rate)
            count[i] = len(got)
            left[begin[i]:begin[i] + len(got)] = got
        wide = np.where(size > LONG, 0, (size + 3) // 4 * 4)
        for n in np.unique(wide[wide > 0]):
            at = np.flatnonzero(wide == n)
            for lo in range(0, len(at), 16384):
                part = at[lo:lo + 16384]
                inside = np.arange(n) < size[part, None]
                where = np.minimum(begin[part, None] + np.arange(n), len(cp) - 1)
                rows = np.where(inside, symbols[where], -1)
                got, count[part] = together(rows, size[part], keys[part], self.vocab, self.rate)
                stays = np.arange(n) < count[part, None]
                left[where[stays]] = got[stays]
        ids = left[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        ids, count = self._as_bytes(ids, count)
        known = self.known.setdefault(variant, {})
        first = len(self.end) - 1
        known.update(zip(new, range(first, first + len(new))))
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(count)])

    def _as_bytes(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece written as byte pieces."""
        odd = ids < 0
        if not odd.any():
            return ids, count
        cp = np.where(odd, -1 - ids, 0)
        times = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
        out = np.repeat(ids, times)
        at = np.cumsum(times) - times
        for c in np.unique(cp[odd]):
            first = at[odd & (cp == c)]
            for k, b in enumerate(chr(c).encode("utf-8", "surrogatepass")):
                out[first + k] = self.vocab.bytes[b]
        total = np.concatenate([[0], np.cumsum(times)])
        stop = np.cumsum(count)
        return out, total[stop] - total[stop - count]

    def __call__(self, texts: list, variants: list[int]) -> list[np.ndarray]:
        if len(self.end) > self.bound:
            self._forget()
        out: list = [None] * len(texts)
        for variant in dict.fromkeys(variants):
            some = [i for i, v in enumerate(variants) if v == variant]
            parts = [chunks(texts[i] or "") for i in some]
            flat = list(chain.from_iterable(parts))
            known = self.known.setdefault(variant, {})
            new = [c for c in dict.fromkeys(flat) if c not in known]
            if new:
                self._learn(new, variant)
            at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
            n = self.end[at + 1] - self.end[at]
            stop = np.cumsum(n)
            ids = self.flat[np.repeat(self.end[at] - (stop - n), n) + np.arange(n.sum())]
            cut = np.concatenate([[0], stop])[np.cumsum([len(p) for p in parts])[:-1]]
            for i, x in zip(some, np.split(ids, cut)):
                out[i] = x
        return out


class Decoder:
    """Lists of ids, end to end, -> texts."""

    def __init__(self, vocab: Vocabulary):
        back = {i: bytes([b]) for b, i in vocab.bytes.items()}
        say = [back.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(vocab.pieces)]
        self.size = np.array([len(x) for x in say], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(say), np.uint8)

    def __call__(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        n = self.size[ids]
        stop = np.cumsum(n)
        raw = self.flat[np.repeat(self.begin[ids] - (stop - n), n) + np.arange(n.sum())].tobytes()
        cut = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(count)])]
        # Without the mark in front, written as a space.
        return [raw[a + 1:b].decode("utf-8", "surrogatepass") for a, b in zip(cut, cut[1:])]


def encode(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 0, variants: int = 4,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id``, ``variant`` and ``ids``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(variants))
                       .cast("int").alias("variant"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Vocabulary(model_path)))

    def make():
        import pickle

        import pyarrow as pa

        run_one = Encoder(pickle.loads(shipped.value), seed, rate)

        def run(batch):
            ids = run_one(batch.column("text").to_pylist(), batch.column("variant").to_pylist())
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if len(ids) else [], pa.int32())
            values = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)
            return {"doc_id": batch.column("doc_id"), "variant": batch.column("variant"),
                    "ids": values.cast(pa.list_(pa.field("element", pa.int32())))}

        return run

    return map_batches(rows, make, f"doc_id {kind}, variant int, ids array<int>", ("text",), 1 << 21)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids",
           text_col: str = "text") -> DataFrame:
    """All columns of ``encoded`` and the text its ids stand for; null ids give a null text."""
    names = encoded.columns
    at = names.index(ids_col)
    rows = encoded.toDF(*[f"c{i}" for i in range(len(names))])
    shipped = encoded.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Vocabulary(model_path)))

    def make():
        import pickle

        say = Decoder(pickle.loads(shipped.value))

        def run(batch):
            ids = batch.column(at)
            count = ids.value_lengths().fill_null(0).to_numpy()
            texts = say(ids.flatten().to_numpy(), count)
            null = ids.is_null().to_pylist()
            return {f"c{i}": batch.column(i) for i in range(len(names))} | {
                "text": [None if x else t for t, x in zip(texts, null)]}

        return run

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema))
    # A few numbers are held for each byte of text, so the groups are small.
    return map_batches(rows, make, f"{schema}, text string", (f"c{at}",), 1 << 20).toDF(*names, text_col)
