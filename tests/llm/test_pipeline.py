from collections import defaultdict

import numpy as np

import corpus_pipeline as CP
from corpuslens.llm import langid, neardup, pii, quality
from corpuslens.llm.common import written

from ..conftest import SF_CHECK


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    kept = [docs]
    for name, stage in CP.STAGES:
        out = stage(spark, kept[-1], SF_CHECK)
        if name != "packing":
            assert out.columns == list(CP.COLUMNS)
        kept.append(written(out, "test"))
    rows = [t.collect() for t in kept]
    first, good, told, one, clean, pieces = rows
    texts = {r["doc_id"]: r["text"] for r in first}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    # Quality: what goes is what the draw leaves out; clean documents stay.
    drawn = {r["doc_id"] for r in quality.resample(
        docs, spark.read.parquet(f"{SF_CHECK}/labels.parquet"), keep=["doc_id"]).where("kept").collect()}
    assert {r["doc_id"] for r in good} == drawn
    ids = {r["doc_id"] for r in good}
    assert sum(labels[i] == 1 and i not in ids for i in labels) <= 0.05 * sum(labels.values())
    # Language: every text with letters that the model is sure of stays.
    assert {r["doc_id"] for r in told} <= ids and len(told) >= 0.98 * len(good)
    assert all(langid.words_of(r["text"]) for r in told)
    # Near duplicates: no two of those kept are alike, and each that went is like one kept.
    hashes = quality.WordHashes()
    seq = {r["doc_id"]: neardup.shingles(hashes.of(neardup.words_of(r["text"]))) for r in told}
    left = {r["doc_id"] for r in one}
    by = defaultdict(list)
    for i in seq:
        for s in set(seq[i].tolist()):
            by[s].append(i)
    pairs = {tuple(sorted((a, b))) for v in by.values() if len(v) < 50 for a in v for b in v if a != b}
    alike = [p for p, y in zip(pairs, neardup.similar([(seq[a], seq[b]) for a, b in pairs], 0.8)) if y]
    assert not [p for p in alike if p[0] in left and p[1] in left]
    partners = {x for p in alike for x in p}
    assert all(i in partners for i in seq if i not in left)
    # Personal data: masked in place, all else as it was.
    for r in clean:
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not any(c.isdigit() or c == "@" for c in texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]]
    assert {r["doc_id"] for r in clean} == left
    # Packing: every id once, and the texts come back from the sequences.
    from corpuslens.llm.packing import encoder

    encode = encoder(CP._tokenizer("byte_bpe_50k.tiktoken"), CP._tokenizer("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in pieces:
        got[r["doc_id"]].append((r["start"], r["ids"]))
    assert set(got) == left
    for r in clean:
        ids = np.frombuffer(b"".join(bytes(x) for _, x in sorted(got[r["doc_id"]])), "<u4").tolist()
        assert ids == [*encode(r["text"]), 0]


def test_run_registered(spark):
    import __spark_entry__ as E

    assert E.queries()["pipeline"] is CP.run and "pipeline" not in E.oracle_sql()
    assert CP.run(spark, "/root/testdata/sf0.001").count() > 0
