import random
import time
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import packing as K

from ..conftest import SF_SMALL
from .common import hard, hard_rows, none

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, ids_of, capacity=1024):
    """Every id in exactly one piece, sequences gapless and of an allowed length."""
    want, got, seqs = defaultdict(list), defaultdict(list), defaultdict(list)
    for doc, text in texts:
        want[doc].append(ids_of(text))
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] >= 1
        got[doc := r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
    assert set(got) == set(want)
    for doc, pieces in got.items():
        flat = sorted((s, tuple(i), n) for s, i, n in pieces)
        every = sorted((k, v) for ids in want[doc] for k, v in enumerate(ids))
        assert sorted((s + k, v) for s, ids, _ in flat for k, v in enumerate(ids)) == every
    for parts in seqs.values():
        at = 0
        for offset, length, total in sorted(parts):
            assert offset == at
            at += length
        assert at == total <= capacity and (total & (total - 1)) == 0


def test_ids_equal_the_library(ids_of):
    encode = K.encoder(RANKS, JSON)
    r = random.Random(2)
    alphabet = "ab Cd\n\t'sé中😀0 1²\x1c\x85  _.,!-<|endoftext|>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(2000)]
    for t in [*texts, "<|endoftext|>", "a" * 5000, " " * 3000, "don't we'll I'M"]:
        assert [*encode(t), 0] == ids_of(t)


def test_table(spark, ids_of):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(3)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    check(K.pack(docs, RANKS, JSON).collect(), texts, ids_of)


def test_hard_rows(spark, ids_of):
    texts = [(r[0], r[1]) for r in hard_rows()]
    check(K.pack(hard(spark), RANKS, JSON).collect(), texts, ids_of)
    check(K.pack(hard(spark), RANKS, JSON, capacity=64).collect(), texts, ids_of, 64)
    assert K.pack(none(spark), RANKS, JSON).collect() == []
    with pytest.raises(ValueError):
        K.pack(hard(spark), RANKS, JSON, capacity=1000)


def laid(lengths, least=1):
    """Pieces of documents of these lengths, and each sequence's pieces."""
    bins, found = K.Bins(1024, 0, least), []
    for d, n in enumerate(lengths):
        found += bins.add((d, 0, n, np.full(n, d, "<u4").tobytes(), n))
    found += bins.close()
    assert all(np.frombuffer(p[3], "<u4").tolist() == [p[0]] * p[2] for p, *_ in found)
    seqs = defaultdict(list)
    for p, s, at, total in found:
        assert at == sum(q[2] for q in seqs[s])
        seqs[s].append(p)
    by_doc = defaultdict(list)
    for p, *_ in found:
        by_doc[p[0]].append((p[1], p[2]))
    for d, n in enumerate(lengths):
        at = 0
        for start, length in sorted(by_doc[d]):
            assert start == at
            at += length
        assert at == n
    return found, seqs


def test_classes_and_cuts():
    r = random.Random(1)
    mixed = [min(int(r.lognormvariate(5.5, 1.2)) + 1, 9000) for _ in range(3000)]
    for lengths in (mixed, [700] * 500, [1] * 5000, [1024] * 9, [513] * 301, [r.randint(1, 1023) for _ in range(2000)]):
        found, seqs = laid(lengths)
        sizes = [sum(p[2] for p in ps) for ps in seqs.values()]
        assert all(n == 1024 or n & (n - 1) == 0 for n in sizes) and sum(n < 1024 for n in sizes) <= 10
        # Whole remainders of one class stand in a bin by the class's count, then its filler.
        whole = defaultdict(int)
        for s, ps in seqs.items():
            k = 1024 // ps[0][2]
            if len(ps) >= k and all(p[1] % 1024 == 0 and p[1] + p[2] == p[4] and 1024 // p[2] == k for p in ps[:k]):
                whole[s] = k
        several = sum(len(ps) > 1 for ps in seqs.values())
        assert lengths is not mixed or len(whole) > 0.8 * several > 500
    found, _ = laid(mixed)
    assert len(found) < 2.5 * len(mixed)
    assert sum(p[2] <= 8 for p, *_ in found) < 0.05 * len(found)
    found, seqs = laid(mixed, least=64)
    assert sum(sum(p[2] for p in ps) & (sum(p[2] for p in ps) - 1) > 0 for ps in seqs.values()) <= 1
    assert K.tail(1023) == [512, 256, 128, 64, 32, 16, 8, 4, 2, 1] and K.tail(200, 64) == [128, 64, 8] and K.tail(0) == []


def test_pieces_per_document(spark):
    rows = K.pack(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), RANKS, JSON).collect()
    docs = {r["doc_id"]: r["doc_tokens"] for r in rows}
    least = sum(-(-n // 1024) for n in docs.values())
    assert len(rows) < 1.5 * least


def test_special_tokens_as_the_plain_call(spark):
    """The contract's ids: tokenizers as it comes, with add_special_tokens=False."""
    t = Tokenizer.from_file(JSON)
    encode = K.encoder(RANKS, JSON, special=True)
    r = random.Random(3)
    parts = ["<|endoftext|>", "<|endoftext|>", "a", " b", " ", "\n", "é", "<|", "|>", "endoftext", "don't", "12"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(1000)]
    for s in [*texts, "a<|endoftext|>b", "<|endoftext|>"]:
        assert encode(s) == t.encode(s, add_special_tokens=False).ids
    assert encode("a<|endoftext|>b") == [64, 50256, 65]
    docs = spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string")
    check(K.pack(docs, RANKS, JSON).collect(), list(enumerate(texts[:50])),
          lambda s: [*t.encode(s, add_special_tokens=False).ids, 0])


def test_very_long_runs():
    from tokenizers import Tokenizer

    encode = K.encoder(RANKS, JSON, special=True)
    plain = Tokenizer.from_file(JSON)
    for t in (" " * 2_000_000, "a" + "\n" * 1_000_000 + "b", "x" + " " * 1_500_000 + "<|endoftext|>" + " y" * 50_000):
        begin = time.time()
        got = encode(t)
        assert time.time() - begin < 20
        assert got == plain.encode(t, add_special_tokens=False).ids
