from collections import Counter

from pyspark.sql import functions as F

from corpuslens.operators import lemmas as L


def _levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_lemma_table_brute_force(spark):
    words = ["cats", "cat", "boxes", "box", "women", "dogs", "churches", "church", "ladies", "lady",
             "is", "i", "glasses", "glass"]
    toks = spark.createDataFrame([(1, words)], "id long, t array<string>")
    d = L.distinct_tokens(toks, "t")
    got = dict((r.token, r.lemma) for r in L.lemma_table(d, d.select(F.col("token").alias("word")))
               .collect())
    known = set(words)
    exp = {}
    for w in known:
        cands = [(len(w), 0, w)]
        for i, (suf, rep) in enumerate(L.NOUN_RULES):
            if w.endswith(suf) and len(w) > len(suf):
                c = w[: len(w) - len(suf)] + rep
                if c in known:
                    cands.append((len(c), i + 1, c))
        best = min(cands)[2]
        if best != w:
            exp[w] = best
    assert got == exp


def test_spelling_brute_force(spark):
    corpus = (["spelling"] * 9 + ["spelled"] + ["them"] * 6 + ["then"] * 6 + ["speling", "thme", "xq", "cuty", "a", "ts", "éth", "thé"] + ["cats"] * 9 + ["at"] * 7)
    toks = spark.createDataFrame([(1, corpus)], "id long, t array<string>")
    d = L.distinct_tokens(toks, "t")
    dic = d.where(F.col("freq") >= 5).select(F.col("token").alias("word"), "freq")
    got = dict((r.token, r.lemma) for r in L.correction_table(d, dic, 2, 0.85).collect())
    freq = Counter(corpus)
    dictionary = {w: c for w, c in freq.items() if c >= 5}
    exp = {}
    for t in freq:
        if t in dictionary:
            continue
        by_dist = {}
        for w, c in dictionary.items():
            dd = _levenshtein(t, w)
            if dd <= 2:
                by_dist.setdefault(dd, []).append((c, w))
        if by_dist:
            cls = by_dist[min(by_dist)]
            c, w = max(cls)
            if c / sum(x for x, _ in cls) >= 0.85:
                exp[t] = w
    assert got == exp
    assert got.get("speling") == "spelling" and "thme" not in got and got.get("cuty") == "cats"


def test_near_words_equal_all_pairs(spark):
    import random

    r = random.Random(2)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(120)}
    tokens = {"".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(120)}
    dic = spark.createDataFrame([(w, 1) for w in words], "word string, freq long")
    tok = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {(x.token, x.word): x.dist for x in L.near_words(tok, dic, 2).collect()}
    assert got == {(t, w): d for t in tokens for w in words if (d := _levenshtein(t, w)) <= 2}


def test_map_tokens_both_ways(spark):
    rows = [(1, ["cats", "a", "cats", "b"]), (2, []), (3, None), (1, ["a"]), (None, ["cats", None])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    table = spark.createDataFrame([("cats", "cat"), ("b", "b")], "token string, lemma string")
    for drop in (False, True):
        out = [sorted((str(r.id), str(r.t), r.o) for r in
                      L.map_tokens(df, "id", "t", table, "o", drop, max_bytes=size).collect())
               for size in (1 << 20, 0)]
        assert out[0] == out[1]
    assert ("2", "[]", []) in out[0] and ("1", "['cats', 'a', 'cats', 'b']", ["cat", "cat", "b"]) in out[0]


def test_long_words_meet_by_segments(spark):
    """Lengths around the one up to which words are found by deletions, and empty ones."""
    import random

    r = random.Random(5)
    words = {"".join(r.choice("ab") for _ in range(r.randint(9, 16))) for _ in range(150)} | {"x" * 300, "a"}
    tokens = set()
    for w in words:
        for _ in range(2):
            t = list(w)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(t) + 1)
                t[k:k + r.randint(0, 1)] = [r.choice("abc")] * r.randint(0, 1)
            tokens.add("".join(t))
    dic = spark.createDataFrame([(w, 1) for w in words], "word string, freq long")
    tok = spark.createDataFrame([(t,) for t in tokens | {""}], "token string")
    for most in (1, 2):
        got = {(x.token, x.word): x.dist for x in L.near_words(tok, dic, most).collect()}
        assert got == {(t, w): d for t in tokens | {""} for w in words if (d := _levenshtein(t, w)) <= most}


def test_table_in_place_stays_in_arrow(spark, monkeypatch):
    """The table reaches the workers as columns: no row of it becomes a Python object."""
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.createDataFrame([(1, ["cats", None, "x"]), (2, None), (3, [])], "id long, t array<string>")
    table = spark.createDataFrame([("cats", "cat"), (None, "no")], "token string, lemma string")
    out = {drop: L._map_in_place(df, "t", table.limit(0) if drop is None else table, "o", bool(drop))
           for drop in (False, True, None)}
    want = {False: [["cat", "x"], [], []], True: [["cat"], [], []], None: [["cats", "x"], [], []]}
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: (_ for _ in ()).throw(AssertionError("collected")))
        L._map_in_place(df, "t", table, "o", False)
    assert {k: [r.o for r in v.orderBy("id").collect()] for k, v in out.items()} == want


def test_lemma_table_in_one_pass(spark):
    """Tokens that no rule applies to are left out before any join; exceptions still reach them."""
    words = ["cats", "cat", "men", "man", "women", "mice", "bus", "s", "dog", None]
    d = spark.createDataFrame([(w,) for w in words], "token string")
    exc = spark.createDataFrame(list(L.IRREGULAR), "form string, lemma string")
    known = d.select(F.col("token").alias("word"))
    table = L.lemma_table(d, known, exc)
    assert sorted(map(tuple, table.collect())) == [("cats", "cat"), ("men", "man"), ("mice", "mouse"),
                                                   ("women", "woman")]
    assert "Union" not in table._jdf.queryExecution().optimizedPlan().toString()
    # Not among the known words: its own form doesn't count.
    few = spark.createDataFrame([("woman",)], "word string")
    assert sorted(map(tuple, L.lemma_table(d, few).collect())) == [("women", "woman")]


def test_large_table_maps_rows_that_are_equal(spark):
    rows = [(1, ["a", "b"]), (1, ["a", "b"]), (2, ["b", None]), (None, ["a"]), (3, None)]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    table = spark.createDataFrame([("a", "x")], "token string, lemma string")
    out = L.map_tokens(df, "id", "t", table, "o", max_bytes=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "first(" not in plan  # whole documents aren't shuffled to find equal ones
    assert sorted(((r.id or 0), r.o) for r in out.collect()) == [
        (0, ["x"]), (1, ["x", "b"]), (1, ["x", "b"]), (2, ["b"]), (3, [])]


def test_known_words_stay_off_the_driver(spark, monkeypatch, tmp_path):
    """spell_correct over its bound: the table is joined, no side of a join is broadcast, hot words are salted alone."""
    from corpuslens.plans import lexicon_q

    texts = ["the the the cat sat"] * 6 + ["the cot saat xyzzyq", "", None, "the caat"]
    rows = [(i // 2, t) for i, t in enumerate(texts)]  # ids come twice
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((r.doc_id, r.corrected, r.n_tokens) for r in lexicon_q.spell_correct(spark, str(tmp_path)).collect())
    assert (3, "the sat", 2) in want or (3, "the cat sat", 3) in want
    monkeypatch.setattr(lexicon_q, "DICT_MAX_BYTES", 0)
    monkeypatch.setattr(L, "_map_in_place", lambda *a: (_ for _ in ()).throw(AssertionError("sent by the driver")))
    out = lexicon_q.spell_correct(spark, str(tmp_path))
    got = sorted((r.doc_id, r.corrected, r.n_tokens) for r in out.collect())
    assert got == want
    near = L.near_words(spark.createDataFrame([("cot",)], "token string"),
                        spark.createDataFrame([("cat", 6)], "word string, freq long"))
    assert near.count() == 1
    for df in (out, near):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    d = spark.createDataFrame([("the", 5000), ("a", 2), ("b", 1)], "token string, freq long")
    assert L.hot_tokens(d) == ["the"] and L.hot_tokens(d.limit(0)) == []
