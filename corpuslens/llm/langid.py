"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum, over all ways to cut it into pieces, of the
product of their probabilities (forward algorithm); a text's log probability is
the sum over its words, so the segmentation is never chosen. Words are runs of
letters, lower-cased, with the vocabulary's word mark in front. A letter run over
MAX_WORD letters is cut every MAX_WORD, so tables stay small and no text is cut
short. The piece probabilities are learnt by expectation-maximisation (forward-
backward expected counts) from word counts of labelled documents, at most about ``bound``
documents a language, picked by a hash of the id.

The prediction is the language of the highest log probability under equal priors
(ties: first in alphabetical order); the score is its posterior. Scoring works on
the distinct words of a group of texts and remembers words across groups.

Defined cases: a null text and one without letters give ``und`` with score 0; with no
labelled document every text is ``und``; labels that are null teach nothing; repeated
rows repeat their result; an empty table gives an empty table; ``identify`` keeps the
columns asked for, whatever their names.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, map_batches, written

UNKNOWN = "und"
MAX_WORD = 32
MAX_PIECE = 12
#: Probability of a letter that no piece covers.
FLOOR = 1e-9
_LETTERS = re.compile(r"[^\W\d_]{1,%d}" % MAX_WORD)
_MARK = "▁"


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def vocabulary(model_path: str) -> list[str]:
    """The letter pieces of a SentencePiece vocabulary file that a lower-cased word can hold."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return sorted({p for p in pieces if p == p.lower() and len(p) <= MAX_PIECE
                   and re.fullmatch(f"{_MARK}?[^\\W\\d_]*", p)})


class PieceTable:
    """Numbers of pieces by a hash of their letters, looked up for many strings at a time: a
    table of SLOTS slots a bucket, with a multiplier under which they suffice."""

    BITS, SLOTS = 18, 3

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        keys = np.array([self._hash(np.array([[ord(c) for c in p]], np.uint64))[0] for p in pieces],
                        np.uint64).reshape(-1)
        r = np.random.default_rng(0)
        while True:
            self.factor = np.uint64(int(r.integers(1 << 62)) * 2 + 1)
            at = self._bucket(keys)
            order = np.argsort(at, kind="stable")
            same = np.arange(len(at)) - np.searchsorted(at[order], at[order])
            if (same < self.SLOTS).all():
                break
        self.keys = np.zeros((self.SLOTS, 1 << self.BITS), np.uint64)
        self.ids = np.full((self.SLOTS, 1 << self.BITS), -1, np.int32)
        self.keys[same, at[order]] = keys[order]
        self.ids[same, at[order]] = order

    @staticmethod
    def step(h, letters):
        with np.errstate(over="ignore"):
            return (h ^ letters) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)

    def _hash(self, letters: np.ndarray) -> np.ndarray:
        h = np.zeros(len(letters), np.uint64)
        for k in range(letters.shape[1]):
            h = self.step(h, letters[:, k])
        return h

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * self.factor) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray, none: int) -> np.ndarray:
        """Number of the piece of each hash, or ``none``."""
        at = self._bucket(h)
        out = np.where(self.keys[0, at] == h, self.ids[0, at], -1)
        for k in range(1, self.SLOTS):
            # Only where the bucket has one more piece.
            left = np.flatnonzero((out < 0) & (self.ids[k, at] >= 0))
            out[left] = np.where(self.keys[k, at[left]] == h[left], self.ids[k, at[left]], -1)
        return np.where(out < 0, np.int32(none), out)


def lattice(words: list[str], pieces: PieceTable) -> np.ndarray:
    """(words, n, MAX_PIECE) piece numbers of marked words of one length n: entry (j, k)
    is the piece of k + 1 letters from j. pieces.size is a letter without a piece,
    pieces.size + 1 no piece."""
    n, v = len(words[0]), pieces.size
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(
        len(words), n).astype(np.uint64).T.copy()
    out = np.full((n, MAX_PIECE, len(words)), v + 1, np.int32)
    for j in range(n):
        h = np.zeros(len(words), np.uint64)
        for k in range(min(MAX_PIECE, n - j)):
            h = pieces.step(h, letters[j + k])
            out[j, k] = pieces.find(h, v if k == 0 else v + 1)
    return out.transpose(2, 0, 1)


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(words, n + 1, languages) probability of each prefix, summed over its segmentations.
    p: (pieces + 2, languages). Words are at most MAX_WORD letters, so nothing underflows."""
    w, n, m = ids.shape
    alpha = np.zeros((n + 1, w, p.shape[1]))
    alpha[0] = 1.0
    none = len(p) - 1
    for i in range(1, n + 1):
        for k in range(min(m, i)):
            at = ids[:, i - 1 - k, k]
            some = np.flatnonzero(at != none)
            if 2 * len(some) > w:
                alpha[i] += alpha[i - 1 - k] * p[at]
            elif len(some):
                alpha[i, some] += alpha[i - 1 - k, some] * p[at[some]]
    return alpha.transpose(1, 0, 2)


def expected(words: list[str], counts: np.ndarray, p: np.ndarray,
             pieces: PieceTable) -> np.ndarray:
    """Expected uses of every piece in the words (each ``counts`` times); p has one column."""
    total = np.zeros(len(p))
    by_len: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_len.setdefault(len(w), []).append(i)
    for n, at in by_len.items():
        ids = lattice([words[i] for i in at], pieces)
        alpha = forward(ids, p)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[:, n] = 1.0
        for j in range(n - 1, -1, -1):
            for k in range(min(MAX_PIECE, n - j)):
                beta[:, j] += p[ids[:, j, k], 0] * beta[:, j + k + 1]
        scale = counts[at] / alpha[:, n]
        for j in range(n):
            for k in range(min(MAX_PIECE, n - j)):
                use = alpha[:, j] * p[ids[:, j, k], 0] * beta[:, j + k + 1] * scale
                total += np.bincount(ids[:, j, k], use, len(p))
    return total


def train(docs: DataFrame, pieces: list[str], lang_col: str = "lang", id_col: str = "doc_id",
          text_col: str = "text", bound: int = 3_000, rounds: int = 4, smooth: float = 0.05):
    """(languages, piece probabilities): ``rounds`` of expectation-maximisation over the word counts
    of at most about ``bound`` documents a language. The languages are a label set: their
    number, and pieces x languages, bound what reaches the driver."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces) + 2, 0))
    rate = F.create_map(*chain.from_iterable(
        (F.lit(g), F.lit(bound / sizes[g])) for g in langs))
    part = drawn(rate[F.col("lang")], F.col("id").cast("string"))

    def make():
        from collections import Counter

        def run(batch):
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.update((lang, w) for w in words_of(text))
            return {"lang": [k[0] for k in found], "word": [k[1] for k in found],
                    "n": list(found.values())}

        return run

    words = map_batches(rows.where(part), make, "lang string, word string, n long", ("text",))
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    number = PieceTable(pieces)
    p = np.full((len(pieces) + 2, len(langs)), 1.0 / len(pieces))
    p[-2:] = [[FLOOR], [0.0]]
    for _ in range(rounds):
        p = _round(words, number, langs, p, smooth)
    return langs, p


def _round(words: DataFrame, number: PieceTable, langs: list, p: np.ndarray, smooth: float) -> np.ndarray:
    shipped = words.sparkSession.sparkContext.broadcast(cloudpickle.dumps((number, langs, p)))

    def run(batches):
        import pickle

        number, langs, p = pickle.loads(shipped.value)
        total = np.zeros_like(p)
        for batch in batches:
            lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()])
            marked = [_MARK + w for w in batch.column("word").to_pylist()]
            n = batch.column("n").to_numpy().astype(float)
            for g in range(len(langs)):
                at = np.flatnonzero(lang == g)
                if len(at):
                    total[:, g] += expected([marked[i] for i in at], n[at], p[:, g:g + 1], number)
        piece, g = np.nonzero(total[:-2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece), pa.array(g), pa.array(total[piece, g])], ["piece", "lang", "n"])

    got = words.mapInArrow(run, "piece long, lang long, n double")
    new = np.zeros_like(p)
    for r in got.groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():  # pieces x languages
        new[r["piece"], r["lang"]] = r["n"]
    new[:-2] += smooth
    new[:-2] /= new[:-2].sum(0)
    new[-2:] = [[FLOOR], [0.0]]
    return new


class Scorer:
    """text -> log probability under each language, over remembered words."""

    def __init__(self, pieces: PieceTable, p: np.ndarray, bound: int = 200_000):
        self.pieces, self.p, self.bound = pieces, p, bound
        self.number: dict[str, int] = {}
        self.logs = np.zeros((0, p.shape[1]))

    def _learn(self, new: list[str]) -> None:
        rows = np.zeros((len(new), self.p.shape[1]))
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(new):
            by_len.setdefault(len(w), []).append(i)
        for at in by_len.values():
            for lo in range(0, len(at), 8192):
                part = at[lo:lo + 8192]
                ids = lattice([_MARK + new[i] for i in part], self.pieces)
                rows[part] = np.log(forward(ids, self.p)[:, -1])
        for w in new:
            self.number[w] = len(self.number)
        self.logs = np.concatenate([self.logs, rows])

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) log probabilities; the number of words of each text."""
        if len(self.number) > self.bound:
            self.number, self.logs = {}, self.logs[:0]
        words = [words_of(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        flat = list(chain.from_iterable(words))
        new = [w for w in dict.fromkeys(flat) if w not in self.number]
        if new:
            self._learn(new)
        out = np.zeros((len(texts), self.p.shape[1]))
        if flat:
            at = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            some = n > 0
            out[some] = np.add.reduceat(self.logs[at], begin[some])
        return out, n


def identify(docs: DataFrame, model, pieces: list[str], text_col: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all), ``lang_pred`` and ``score`` (0 to 1)."""
    keep = docs.columns if keep is None else keep
    names = [*dict.fromkeys([*keep, text_col])]
    at = names.index(text_col)
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    fields = [f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))]
    langs, p = model
    shipped = docs.sparkSession.sparkContext.broadcast(
        cloudpickle.dumps((langs, p, PieceTable(pieces))))

    def make():
        import pickle

        langs, p, pieces = pickle.loads(shipped.value)
        score = Scorer(pieces, p)

        def run(batch):
            kept = {f"c{i}": batch.column(i) for i in range(len(keep))}
            if not langs:
                return kept | {"lang_pred": [UNKNOWN] * batch.num_rows, "score": [0.0] * batch.num_rows}
            logs, n = score(batch.column(at).to_pylist())
            best = logs.argmax(1)
            sure = 1.0 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            return kept | {"lang_pred": [langs[b] if m else UNKNOWN for b, m in zip(best, n)],
                           "score": np.where(n > 0, sure, 0.0)}

        return run

    schema = ", ".join([*fields, "lang_pred string, score double"])
    return map_batches(rows, make, schema, (f"c{at}",)).toDF(*keep, "lang_pred", "score")
