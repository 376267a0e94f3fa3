import itertools
import math

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import langid as G
from corpuslens.llm.queries import op1_language

from ..conftest import SF_CHECK
from .common import SCHEMA, hard, none, row


def segmentations(word, pieces):
    """All ways to cut a word into pieces; a letter without piece stands alone."""
    if not word:
        yield ()
    for k in range(1, min(len(word), G.MAX_PIECE) + 1):
        if word[:k] in pieces or k == 1:
            for rest in segmentations(word[k:], pieces):
                yield (word[:k], *rest)


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aab", "▁", "▁a", "bab"])}
    rng = np.random.default_rng(1)
    p = np.vstack([rng.random((len(pieces), 2)), np.full((1, 2), 0.01), np.zeros((1, 2))])
    for n in range(1, 7):
        words = ["▁" + "".join(w) for w in itertools.product("abz", repeat=n)][:200]
        got = G.forward(G.lattice(words, G.PieceTable(list(pieces))), p)[:, -1]
        for w, g in zip(words, got):
            want = sum(np.prod([p[pieces.get(s, len(pieces))] for s in seg], axis=0)
                       for seg in segmentations(w, pieces))
            assert np.allclose(g, want)
    words, count = ["▁ab", "▁aab", "▁bab"], np.array([2.0, 1.0, 3.0])
    total = G.expected(words, count, p[:, :1], G.PieceTable(list(pieces)))
    want = np.zeros(len(p))
    for w, c in zip(words, count):
        segs = list(segmentations(w, pieces))
        prob = np.array([np.prod([p[pieces.get(s, len(pieces)), 0] for s in seg]) for seg in segs])
        for seg, q in zip(segs, prob / prob.sum() * c):
            for s in seg:
                want[pieces.get(s, len(pieces))] += q
    assert np.allclose(total, want)


def test_scorer_sums_words():
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "▁a"])}
    p = np.vstack([np.random.default_rng(2).random((4, 3)), np.full((1, 3), 0.1), np.zeros((1, 3))])
    table = G.PieceTable(list(pieces))
    s = G.Scorer(table, p, bound=2)
    texts = ["a b ab", None, "", "12 !", "ab zz", "x" * 100]
    for _ in range(2):
        logs, n = s(texts)
        assert n.tolist() == [3, 0, 0, 0, 2, 4]
        for t, row_ in zip(texts, logs):
            want = sum((np.log(G.forward(G.lattice(["▁" + w], table), p)[0, -1])
                        for w in G.words_of(t)), np.zeros(3))
            assert np.allclose(row_, want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = op1_language(spark, SF_CHECK).join(docs.select("doc_id", "lang"), "doc_id").cache()
    assert got.count() == docs.count()
    held = got.where("held_out")
    right = held.where("lang = lang_pred").count() / held.count()
    assert right >= 0.97
    bad = got.where(~F.col("score").between(0, 1)).count()
    crc = got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))
    assert bad == 0 and crc.count() == 0


@pytest.fixture(scope="module")
def pieces():
    return G.vocabulary(P.path("piece_bpe_32k.model"))


def test_hard_rows(spark, pieces):
    model = G.train(hard(spark), pieces, rounds=1)
    assert model[0] == ["en"]
    rows = G.identify(hard(spark).coalesce(1), model, pieces)
    assert rows.columns == [*hard(spark).columns, "lang_pred", "score"]
    for r in rows.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0.0)
    assert G.identify(none(spark), model, pieces).collect() == []
    empty = G.train(none(spark), pieces)
    assert empty[0] == []
    got = G.identify(hard(spark), empty, pieces, keep=["doc_id"]).collect()
    assert {r["lang_pred"] for r in got} == {"und"}
    # The sample's bound follows the label; a null one teaches nothing.
    two = spark.createDataFrame([row(i, "a b c", "x" if i % 2 else None) for i in range(400)], SCHEMA)
    assert G.train(two, pieces, bound=10, rounds=1)[0] == ["x"]
    assert not math.isnan(G.train(two, pieces, bound=0, rounds=1)[1].sum())
