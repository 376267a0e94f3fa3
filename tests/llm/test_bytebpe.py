import hashlib
import random
import time

import public_tokenizers as P
import pytest
import regex

from corpuslens.llm import bytebpe as B
from corpuslens.llm import queries as Q

from ..conftest import SF_SMALL
from .common import hard, hard_rows, none

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return B.Codec(RANKS, P.PATTERN)


def brute(text, ranks):
    """Each match alone: the adjacent parts of the least rank are joined, over and over."""
    out = []
    for m in regex.findall(P.PATTERN, text):
        parts = [bytes([b]) for b in m.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        out += [ranks[p] for p in parts]
    return out


def odd_texts(n, seed, alphabet=" \n\t\r\x1c\x85 　ab1'sétll中文😀!._  "):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_equals_brute_force(codec):
    ranks = B.ranks_of(RANKS)
    for t in [*odd_texts(200, 1), "Das schöne Haus wasn't there.  Was?", "it's 12,345"]:
        # Python's regex counts \x1c as white space, the pattern's own engine doesn't.
        if "\x1c" not in t:
            assert codec.encode(t).tolist() == brute(t, ranks), repr(t)


def test_cuts_change_nothing(codec, monkeypatch):
    monkeypatch.setattr(B, "_RUN", regex.compile(f"[{B._SPACE}]{{2,}}"))
    cut = B.Codec(RANKS, P.PATTERN, block=6)
    for t in odd_texts(3000, 2):
        assert "".join(p for p, _ in B.split(t, 6)) == t
        assert cut.encode(t).tolist() == codec.encode(t).tolist(), repr(t)


def test_long_runs_take_seconds(codec):
    for t in (" " * 3_000_000, "\n" * 2_000_000 + "x", "a" * 2_000_000, "!?" * 500_000,
              "word " * 400_000, "中" * 300_000, " \n" * 500_000 + " x" * 10):
        begin = time.time()
        assert codec.decode(codec.encode(t).tolist()) == t.encode()
        assert time.time() - begin < 20
    t = "x" + "\t" * 200_000 + "y" + " " * 100_000 + "z"
    assert codec.encode(t).tolist() == codec._whole.encode_ordinary(t)


def test_rows(spark):
    for docs in (spark.read.parquet(f"{SF_SMALL}/documents.parquet"), hard(spark)):
        rows = B.decode(B.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
        want = sorted((str(r.doc_id), (r.text or "").encode()) for r in docs.collect())
        assert sorted((str(r.doc_id), bytes(r.raw)) for r in rows) == want
    assert B.decode(B.encode(none(spark), RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0
    got = spark.createDataFrame([(1, None, "k"), (2, [], "k")], "raw int, ids array<int>, `a b` string")
    assert [tuple(r) for r in B.decode(got, RANKS, P.PATTERN).collect()] == [
        (None, "k", b""), ([], "k", b"")]
    assert len(hard_rows()) == B.encode(hard(spark), RANKS, P.PATTERN).count()


def test_query(spark, codec):
    got = {r.doc_id: r for r in Q.op13_bytebpe(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = codec._whole.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
