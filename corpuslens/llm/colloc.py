"""Phrases that occur together more often than their parts, mined by partitions of the corpus (SON).

Texts are lower-cased (A-Z), split into pieces at SEPARATORS and the pieces into words at blanks and tabs;
phrases of 2 to LONGEST words are counted within pieces, for each language by itself. Wanted are those
of at least ``support`` occurrences.

The corpus is dealt into ``shards`` shards, whole scan partitions each. A phrase that occurs ``support`` times
must occur, in at least one shard, as often as that shard's share of the language's words asks for, so
each shard is mined completely at ceil(support x its words / all words), language by language: words
first, then phrases of k words of which both parts of k - 1 words are frequent in the shard. The counts
of a shard are sums over its tasks, so shards may be of any size. What is frequent in any shard, and can
reach ``support`` with what the other shards may hold unseen, is a candidate, and one more pass counts
all candidates in the whole corpus, by their words, exactly.

The frequent phrases of a level travel to the next pass as a table of bits, as many as 16 a phrase up
to MOST_BITS: a phrase that only shares another's bit is counted needlessly and fails the support at the
end, so neither these collisions nor those of 64-bit hashes change a result. Beyond that many phrases
the bits prune less and more is counted.

A candidate is cut into two parts at its weakest place, by a x n / (l x r); this and the comparison of
phrases inside longer ones run on the frequent phrases only, with decimals that can't overflow.

Defined cases: a null text is empty; a null language is ``und``; repeated rows and ids count each; texts
without words and an empty table give no rows; other columns are ignored, whatever their names. ``docs``
is read once a level, and its partitions must be the same each time, as those of a table are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast, salted_join
from ..operators.topk import top_k
from .common import GROUP_BYTES, groups, mix, written

SHARDS = 16
LONGEST = 5
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
MOST_BITS = 1 << 27
#: A byte that stands in no UTF-8 text, for the ends of pieces and of texts.
_PIECE = b"\xff"
_TO = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else _PIECE[0] if b in SEPARATORS else b
            for b in range(256))
_STEP = np.uint64(0x100000001B3)


class Powers:
    """Powers of an odd number modulo 2^64 and their inverses, as many as were asked for."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, GROUP_BYTES * 5 // 4)
            self.up, self.down = (np.cumprod(np.where(np.arange(n) > 0, np.uint64(x), np.uint64(1)), dtype=np.uint64)
                                  for x in (self.BASE, pow(self.BASE, -1, 2 ** 64)))
        return self.up, self.down


class Words(dict):
    """word -> number. Forgets everything when ``fresh`` finds it full."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def fresh(self) -> "Words":
        if len(self) > self.bound:
            self.clear()
        return self


def _parts(raw: bytes) -> Iterator[bytes]:
    """A text, cut at ends of pieces if it is very long."""
    lo = 0
    while len(raw) - lo > GROUP_BYTES:
        cut = raw.rfind(_PIECE, lo, lo + GROUP_BYTES)
        cut = cut if cut > lo else raw.find(_PIECE, lo + GROUP_BYTES)
        if cut < 0:
            break
        yield raw[lo:cut]
        lo = cut
    yield raw[lo:]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, normalised texts of it), some megabytes at a time."""
    held, size = {}, 0
    for raw, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(),
                         batch.column("lang").to_pylist()):
        for part in _parts((raw or b"").translate(_TO)):
            held.setdefault(lang, []).append(part)
            size += len(part)
            if size >= GROUP_BYTES:
                yield from ((x, _PIECE.join(parts)) for x, parts in held.items())
                held, size = {}, 0
    yield from ((x, _PIECE.join(parts)) for x, parts in held.items())


class Grams:
    """The words of some text of one language and the hashes of their phrases, which know the language.
    A word's hash is a polynomial of its bytes, read off running sums."""

    def __init__(self, text: bytes, lang: str, powers: Powers):
        import xxhash

        self.text, self.lang = text, lang
        data = np.frombuffer(text, np.uint8)
        up, down = powers.to(len(data) + 1)
        space, end = data == 32, data == _PIECE[0]
        edge = np.diff(np.concatenate([[False], ~(space | end), [False]]).view(np.int8))
        self.begin, self.end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        # The piece of a word: how many ends of pieces stand before it.
        self.piece = np.searchsorted(np.flatnonzero(end), self.begin)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up[:len(data)], out=total[1:])
        self.own = mix((total[self.end] - total[self.begin]) * down[self.begin])
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.hash = {1: mix(self.own ^ np.uint64(self.seed))}

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether a phrase of k words stands there) of every place; the last k - 1 are cut off."""
        n = max(len(self.own) - k + 1, 0)
        if k not in self.hash:
            h, _ = self.level(k - 1)
            with np.errstate(over="ignore"):
                self.hash[k] = mix(h[:n] * _STEP + self.own[k - 1:] + np.uint64(k))
        return self.hash[k], self.piece[k - 1:] == self.piece[:n]

    def phrase(self, i: int, k: int) -> str:
        return b" ".join(self.text[self.begin[i]:self.end[i + k - 1]].split()).decode("utf-8", "replace")


def told_apart(grams: Grams, k: int, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place, times) of the phrases of k words at some places. Places of one hash whose words differ
    count each by themselves; ``ids`` numbers the words."""
    h = grams.level(k)[0]
    at = at[np.argsort(h[at], kind="stable")]
    s = h[at]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = at[new]
    group = np.cumsum(new) - 1
    same = np.ones(len(at), bool)
    for j in range(k):
        same &= ids[at + j] == ids[first[group] + j]
    odd = at[~same]
    return (np.concatenate([first, odd]),
            np.concatenate([np.bincount(group[same], minlength=len(first)), np.ones(len(odd), np.int64)]))


def _passes(docs: DataFrame, work, schema: str, shards: int) -> DataFrame:
    """``work(grams, shard, words)``, which yields (rows, dict of columns or of single values), over all texts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        from pyspark import TaskContext

        shard, powers, words = TaskContext.get().partitionId() % shards, Powers(), Words()
        for batch in groups(batches, ("text",)):
            for lang, text in _chunks(batch):
                for n, cols in work(Grams(text, lang, powers), shard, words):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, f.type) if isinstance(x := cols[f.name], (list, np.ndarray))
                         else pa.repeat(pa.scalar(x, f.type), n) for f in out], schema=out)

    return docs.mapInArrow(run, schema)


def _local(k: int, known):
    """Phrases of k words whose parts of k - 1 words are frequent in the shard, with their counts."""
    def work(grams, shard, _):
        h, ok = grams.level(k)
        if k > 1 and len(h):
            parts = Bits(known.value).has(grams.level(k - 1)[0], shard)
            ok = ok & parts[:-1] & parts[1:]
        keys, times = np.unique(h[ok], return_counts=True)
        yield len(keys), {"shard": shard, "seed": _signed(np.array([grams.seed], np.uint64)).tolist()[0],
                          "key": _signed(keys), "times": times}

    return work


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _everywhere(known):
    """Candidates with their words, and (size 0) the number of all words."""
    def work(grams, _, words):
        yield 1, {"lang": grams.lang, "phrase": "", "size": 0, "times": len(grams.own)}
        ids = None
        for k in range(1, LONGEST + 1):
            h, ok = grams.level(k)
            at = np.flatnonzero(ok)
            at = at[Bits(known.value).has(h[at], None)]
            if not len(at):
                continue
            if ids is None:
                found = grams.text.replace(_PIECE, b" ").split()
                ids = np.fromiter(map(words.fresh().__getitem__, found), np.int64, len(found))
            first, times = told_apart(grams, k, at, ids)
            yield len(first), {"lang": grams.lang, "size": k, "times": times,
                               "phrase": [grams.phrase(i, k) for i in first.tolist()]}

    return work


class Bits:
    """A table of bits, a power of two of them."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.last = np.uint64(64 * len(words) - 1)

    def has(self, h: np.ndarray, shard: int | None) -> np.ndarray:
        if shard is not None:
            h = h ^ np.uint64((shard + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        p = mix(h) & self.last
        return (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)) > 0


def _bits(found: DataFrame, by_shard: bool) -> Bits:
    """The bits of (shard, key) or, over all shards, of key. At most MOST_BITS / 64 numbers reach the driver."""
    n = found.count()
    size = 1 << min(max(20, (16 * n).bit_length()), MOST_BITS.bit_length() - 1)

    def place(batches):
        for b in batches:
            h = b.column("key").to_numpy().view(np.uint64)
            if by_shard:
                with np.errstate(over="ignore"):
                    h = h ^ (b.column("shard").to_numpy().astype(np.uint64) + np.uint64(1)) \
                        * np.uint64(0x9E3779B97F4A7C15)
            p = mix(h) & np.uint64(size - 1)
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))],
                                             names=["word", "bit"])

    set_ = found.select("shard", "key") if by_shard else found.select("key")
    set_ = set_.mapInArrow(place, "word long, bit long").groupBy("word").agg(
        F.expr("bit_or(bit)").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[set_["word"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)
    return Bits(words)


def _lookup(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a table of unknown size: broadcast if it measures small, else salted."""
    return big.join(F.broadcast(small), keys) if fits_broadcast(small) else salted_join(big, small, keys)


def counts(docs: DataFrame, support: int = 100, text_col: str = "text", lang_col: str = "lang",
           shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, phrase, size, times)): all word occurrences a language, and the phrases of 1 to
    LONGEST words that occur at least ``support`` times."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(text_col).cast("string").alias("text"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))

    def level(k, known=None):
        """Counts by shard; a language goes by the hash of its name."""
        rows = _passes(docs, _local(k, known), "shard int, seed long, key long, times long", shards)
        return rows.groupBy("shard", "seed", "key").agg(F.sum("times").alias("times"))

    words = written(level(1), "words")
    share = words.groupBy("shard", "seed").agg(F.sum("times").alias("own"))
    total = share.groupBy("seed").agg(F.sum("own").alias("n"))
    need = share.join(total, "seed").select("shard", "seed", F.expr(
        f"cast((cast(own as decimal(20,0)) * {support} + n - 1) div n as long)").alias("need"))
    # What all shards together can hold of a phrase that is frequent in none of them.
    rest = need.groupBy("seed").agg(F.sum(F.col("need") - 1).alias("rest"))
    need = written(need.join(rest, "seed"), "supports")

    def frequent(counted: DataFrame, k: int) -> DataFrame:
        """The locally frequent ones, a row per shard."""
        return written(_lookup(counted, need, ["shard", "seed"]).where("times >= need")
                       .select("shard", "key", "times", "need", "rest"), f"level{k}")

    levels = [frequent(words, 1)]
    for k in range(2, LONGEST + 1):
        levels.append(frequent(level(k, sc.broadcast(_bits(levels[-1], True).words)), k))
    union = reduce(DataFrame.unionByName, levels)
    # In shards where it isn't frequent, a phrase stands need - 1 times at most.
    could = union.groupBy("key").agg(
        (F.sum("times") + F.max("rest") - F.sum(F.col("need") - 1)).alias("most")).where(F.col("most") >= support)
    known = sc.broadcast(_bits(written(could.select("key"), "candidates"), False).words)
    every = _passes(docs, _everywhere(known), "lang string, phrase string, size int, times long", shards)
    every = written(every.groupBy("lang", "phrase", "size").agg(F.sum("times").alias("times")).where(
        (F.col("times") >= support) | (F.col("size") == 0)), "phrases")
    return (every.where("size = 0").select("lang", F.col("times").alias("n")),
            every.where("size > 0"))


def collocations(docs: DataFrame, support: int = 100, top: int = 2000, text_col: str = "text",
                 lang_col: str = "lang", shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score."""
    total, known = counts(docs, support, text_col, lang_col, shards)
    every = known.where("size > 1").select("lang", "phrase", F.split("phrase", " ").alias("words"), "size",
                                           F.col("times").alias("a"))

    # Dropped: phrases inside longer ones that are as frequent (100 a hundred; never more so).
    def inside(words, size):
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
            F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(words, i, m), " ")))))

    longer = every.where("size > 2").select("lang", F.explode(inside(F.col("words"), F.col("size")))
                                            .alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    kept = every.join(longer, ["lang", "phrase"], "left").where("coalesce(longer, 0) < a").drop("longer")

    cut = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    times = known.select("lang", "phrase", "times")
    cut = _lookup(cut, times.toDF("lang", "first", "l"), ["lang", "first"])
    cut = _lookup(cut, times.toDF("lang", "rest", "r"), ["lang", "rest"])
    cut = _lookup(cut, total, ["lang"])
    d = {c: f"cast({c} as decimal(20,0))" for c in "anlr"}
    score = F.expr(f"cast((1000 * {d['a']} * {d['n']}) div ({d['l']} * {d['r']}) as long)")
    weakest = cut.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w"))
    rows = weakest.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n",
                          F.col("w.score").alias("score"))
    best = top_k(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, salt_on=["phrase"])
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
