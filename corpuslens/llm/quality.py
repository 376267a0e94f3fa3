"""Quality by importance resampling: hashed n-gram models of target and raw text.

Tokens are words and runs of punctuation; a word that repeats one of the two words
before it is written as a repeat mark, so looping text has n-grams of its own. Unigrams
and bigrams are hashed into ``buckets``. Two bag models are counted over whole texts, in
one pass over all documents: the raw one over every document, the target one over
the documents labelled as such. A document's log weight is the mean over its n-grams of
log p_target - log p_raw, times a fixed number of n-grams. Resampling draws k documents without replacement with
probability proportional to the weight: the Gumbel top-k, log weight plus a Gumbel
number from a keyed hash of the document's id and text. k is the number of documents
that look like the target or not clearly unlike it (log weight of at least LEAST), counted over
all documents, unless the caller gives it. The k-th largest key is found exactly from
histograms, so nothing is sorted or gathered; documents equal to it are all kept.

Defined cases: a null or token-free text has no n-grams and weight 0 (log), as one that
fits either model alike; a label row whose document is missing is ignored, a null label is no
target; repeated rows of one id and text draw the same number and stand or fall together; with
no target document every weight is 0 and all are kept; an empty table gives an empty table; other
columns are kept by ``resample``, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, drawn, groups, map_batches, mix, written

_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: A text weighs as if it had this many n-grams, whatever its length, so that length alone
#: neither draws nor repels; PRIOR n-grams of no weight are added to it first.
COUNTS_AS = 100.0
PRIOR = 20
#: Without a given k, texts of at least this log weight are counted.
LEAST = -10.0
_REPEAT = np.uint64(0x9E3779B97F4A7C15)
#: Tokens and n-grams take many times the bytes of their texts, so few of these are worked on together.
TEXT_BYTES = 1 << 20


def _ngrams(texts: list, words: WordHashes, buckets: int):
    """(buckets of the unigrams and bigrams of all texts, where each text begins)."""
    tokens = [_TOKEN.findall(t) if t else [] for t in texts]
    n = np.array([len(t) for t in tokens], np.int64)
    h = np.concatenate([words.of(t) for t in tokens]) if n.sum() else np.empty(0, np.uint64)
    begin = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(len(h)) - np.repeat(begin[:-1], n)
    marked = h.copy()
    # A punctuation run may stand between a word and its repeat, as in "so, so".
    marked[1:][(h[1:] == h[:-1]) & (place[1:] >= 1)] = _REPEAT
    marked[2:][(h[2:] == h[:-2]) & (place[2:] >= 2)] = _REPEAT
    with np.errstate(over="ignore"):
        pair = mix(marked[1:] * np.uint64(31) + marked[:-1])
    inside = place[1:] >= 1
    grams = np.zeros((len(h), 2), np.int64)
    grams[:, 0] = (mix(marked) % np.uint64(buckets)).astype(np.int64)
    grams[:, 1] = -1  # the first token of a text has no bigram
    if len(h) > 1:
        grams[1:, 1] = np.where(inside, (pair % np.uint64(buckets)).astype(np.int64), -1)
    return grams, begin


def counts(docs: DataFrame, target_col: str, text_col: str = "text",
           buckets: int = 10_000) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents and of those whose ``target_col`` is
    true. Each task adds up its own rows before anything is shuffled."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"),
                       F.coalesce(F.col(target_col), F.lit(False)).alias("target"))

    def run(batches):
        words, total = WordHashes(), np.zeros((2, buckets), np.int64)
        for batch in groups(batches, ("text",), TEXT_BYTES):
            grams, begin = _ngrams(batch.column("text").to_pylist(), words, buckets)
            target = np.repeat(batch.column("target").to_numpy(zero_copy_only=False).astype(bool),
                               np.diff(begin))
            for k, g in enumerate((grams, grams[target])):
                g = g[g >= 0]
                total[k] += np.bincount(g, minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)],
                                         ["bucket", "raw", "target"])

    part = rows.mapInArrow(run, "bucket long, raw long, target long")
    return part.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, target_col: str, text_col: str = "text", buckets: int = 10_000,
        shrink: float = 0.05) -> np.ndarray:
    """log p_target - log p_raw of every bucket (``buckets`` numbers on the driver). The target
    model is drawn to the raw one by ``shrink`` times its own size."""
    c = np.zeros((2, buckets))
    for r in counts(docs, target_col, text_col, buckets).collect():  # at most ``buckets`` rows
        c[:, r["bucket"]] = r["raw"], r["target"]
    if not c[1].sum():
        return np.zeros(buckets)
    raw = (c[0] + 1) / (c[0].sum() + buckets)
    n = c[1].sum()
    return np.log((c[1] + shrink * n * raw) / (n * (1 + shrink))) - np.log(raw)


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and ``n_grams``, ``log_weight`` and
    ``gumbel_key``."""
    keep = docs.columns if keep is None else keep
    names = [*dict.fromkeys([*keep, text_col])]
    at = names.index(text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(ratio))
    # xxhash64 of id and text: the same for a row read again, other for every id
    draw = F.xxhash64(F.lit(seed), docs[id_col].cast("string"), docs[text_col].cast("string"))
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], draw.alias("draw"))
    fields = [f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))]

    def make():
        import pickle

        table, words = pickle.loads(shipped.value), WordHashes()

        def run(batch):
            grams, begin = _ngrams(batch.column(at).to_pylist(), words, len(table))
            # Summed text by text, so a weight doesn't depend on the rows beside it.
            score = np.append(np.append(table, 0.0)[grams].sum(1), 0.0)
            logw = np.where(np.diff(begin) > 0, np.add.reduceat(score, begin[:-1]), 0.0)
            grown = np.concatenate([[0], np.cumsum((grams >= 0).sum(1))])[begin]
            logw *= COUNTS_AS / (np.diff(grown) + PRIOR)
            u = mix(batch.column(len(names)).to_numpy().view(np.uint64))
            u = ((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
            return {f"c{i}": batch.column(i) for i in range(len(keep))} | {
                "n": np.diff(grown), "logw": logw, "key": logw - np.log(-np.log(u))}

        return run

    out = map_batches(rows, make, ", ".join([*fields, "n long, logw double, key double"]),
                      (f"c{at}",), TEXT_BYTES)
    return out.toDF(*keep, "n_grams", "log_weight", "gumbel_key")


def kth_largest(df: DataFrame, col: str, k: int, digits: int = 12) -> float:
    """The exact k-th largest value of a double column, from counts of ``2**digits`` equal
    intervals of the range that still holds it, narrowed until one value is left."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k >= n:
        return lo if n else 0.0
    above, steps = 0, 2 ** digits
    while lo < hi:
        width = (hi - lo) / steps
        if width <= 0 or lo + width == lo:
            break
        slot = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(steps - 1))
        found = {r["s"]: (r["n"], r["a"], r["b"]) for r in
                 df.where(F.col(col).between(lo, hi)).groupBy(slot.alias("s"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("a"), F.max(col).alias("b"))
                 .collect()}  # at most 2**digits rows
        for s in sorted(found, reverse=True):
            if above + found[s][0] >= k:
                _, lo, hi = found[s]
                break
            above += found[s][0]
    return hi if lo == hi else lo


def target_ids(labels: DataFrame, bound: int = 20_000, id_col: str = "doc_id",
               label_col: str = "quality") -> DataFrame:
    """Ids labelled 1, all of them or, beyond ``bound``, about that many by a hash of the id."""
    good = labels.where(F.col(label_col) == 1).select(id_col).where(F.col(id_col).isNotNull())
    n = good.count()
    return good.where(drawn(bound / max(n, 1), id_col)).distinct()


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             k: int | None = None, buckets: int = 10_000, seed: int = 0, bound: int = 20_000,
             keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all), ``n_grams``, ``log_weight``,
    ``gumbel_key`` and ``kept``: whether the document is among the k drawn.

    ``labels`` has ``id_col`` and ``quality``; the target model is fitted on at most about
    ``bound`` of its documents (their ids, a proven bound, are broadcast), the raw model on all.
    """
    ids = target_ids(labels, bound, id_col).select(F.col(id_col).alias("_id"), F.lit(True).alias("_t"))
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(
        F.broadcast(ids), "_id", "left")
    ratio = fit(marked, "_t", "text", buckets)
    keep = docs.columns if keep is None else keep
    narrow = written(weigh(docs, ratio, id_col, text_col, seed,
                           [c for c in keep if c != text_col]), "weighed")
    if k is None:
        k = narrow.where(F.col("log_weight") >= LEAST).count()
    least = kth_largest(narrow, "gumbel_key", k) if k else float("inf")
    # Texts aren't written again: with them, the weights are worked out anew, to the same bits.
    out = weigh(docs, ratio, id_col, text_col, seed, keep) if text_col in keep else narrow
    return out.withColumn("kept", F.col("gumbel_key") >= F.lit(float(least)))
