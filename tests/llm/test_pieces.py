import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from corpuslens.llm import pieces as S

from ..conftest import SF_SMALL
from .common import hard, hard_rows, none

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return S.Vocabulary(MODEL)


def texts():
    r = random.Random(3)
    alphabet = "abcdefgh  \n\t.,;!?()ABCéèß中文字😀0123456789   ²①"
    odd = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(150)]
    return odd + ["a" * 700 + "the quick brown" * 60, " " * 100, "", "  lead", "trail  ", None]


def test_without_dropout_as_the_library(vocab):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = S.Encoder(vocab)(texts(), [0] * len(texts()))
    for ids, t in zip(got, texts()):
        assert ids.tolist() == sp.encode(t or "")


def brute(chunk, key, vocab, enc, rate):
    """Merge the best candidate that isn't skipped, over and over."""
    sym = [(i, s) for i, s in enumerate(enc.symbol[np.array([ord(c) for c in chunk])].tolist())]
    while True:
        best = None
        for j in range(len(sym) - 1):
            (i, a), (_, b) = sym[j:j + 2]
            r = int(vocab.merge(np.array([a]), np.array([b]))[0])
            if r < len(vocab.pieces) and (best is None or r < best[0]) and not (
                    rate and S._dropped(key, np.array([i]), np.array([r]), rate)[0]):
                best = r, j
        if best is None:
            return [s for _, s in sym]
        j = best[1]
        sym[j:j + 2] = [(sym[j][0], int(vocab.of_rank[best[0]]))]


def test_dropout_equals_brute_force(vocab):
    r, enc = random.Random(5), S.Encoder(vocab)
    for _ in range(150):
        chunk = S.MARK + "".join(r.choice("theraing.,éÂ中") for _ in range(r.randint(1, 25)))
        key, rate = np.uint64(r.getrandbits(64)), r.choice([0.1, 0.4])
        want = brute(chunk, key, vocab, enc, rate)
        sym = enc.symbol[np.array([ord(c) for c in chunk])]
        assert S.by_heap(sym.tolist(), key, vocab, rate) == want
        got, n = S.together(sym[None, :], np.array([len(sym)]), np.array([key]), vocab, rate)
        assert got[0, :n[0]].tolist() == want


def test_round_trip_and_variety(vocab):
    every = [t or "" for t in texts()] + ["a▁b ▁▁ c", "▁", "▁ ▁", " ▁"]
    say = S.Decoder(vocab)
    seen = []
    for seed, rate in ((0, 0.0), (1, 0.1), (2, 0.1), (1, 1.0)):
        ids = S.Encoder(vocab, seed, rate)(every, [3] * len(every))
        assert say(np.concatenate(ids), np.array([len(x) for x in ids])) == every
        seen.append([x.tolist() for x in ids])
    assert seen[0] != seen[1] != seen[2]
    again = S.Encoder(vocab, 1, 0.1, bound=5)  # forgetting changes nothing
    assert [again([t], [3])[0].tolist() for t in every] == seen[1]
    assert max(map(len, seen[3])) > max(map(len, seen[0]))


def test_table_and_hard_rows(spark):
    for docs in (spark.read.parquet(f"{SF_SMALL}/documents.parquet"), hard(spark)):
        back = S.decode(S.encode(docs, MODEL), MODEL)
        got = sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str)
        want = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)
        assert got == want
    assert S.decode(S.encode(none(spark), MODEL), MODEL).collect() == []
    r = S.decode(spark.createDataFrame([(1, None), (2, [])], "c0 long, ids array<int>"), MODEL).collect()
    assert [x["text"] for x in r] == [None, ""]
    assert len(hard_rows()) == S.encode(hard(spark), MODEL).count()
