import random
import re
import time

from corpuslens.llm import pii as I

from ..conftest import SF_SMALL
from .common import hard, none

NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    """The base definition, pattern by pattern."""
    out = []
    for kind, rx in NAIVE.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 13 <= len(d) <= 19 and I.luhn(d),
                    "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_equals_patterns():
    r = random.Random(4)
    parts = ["a", "b.c", "@", "x@y.zz", ".", "_", "%", "-", " ", "+1", "+", "(", ")", "12", "4", "255",
             "256", "1.2.3.4", "999.1.1.1", "4111111111111111", "5500-0000 0000 0004", "é", "\n",
             "+49 30 1234567", "0000000000000", "00"]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert I.base_spans(t) == naive(t), t


def test_base_is_linear():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" + "(" * 300_000, "1." * 150_000,
              "a.b@c" * 60_000, "1 " * 150_000):
        began = time.process_time()
        I.base_spans(t)
        assert time.process_time() - began < 3


def test_field_and_viterbi():
    import numpy as np

    model = I.train(I.training_rows())
    w, tr = model
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        s = rng.normal(size=(n, len(I.LABELS))).astype(np.float32) * 3
        import itertools

        best = max(itertools.product(range(len(I.LABELS)), repeat=n), key=lambda y: sum(
            s[i, y[i]] for i in range(n)) + sum(tr[a, b] for a, b in zip(y, y[1:])))
        assert I.viterbi([s], tr)[0].tolist() == list(best)
    held = I.training_rows(4, seed=1234)
    found = I.field_spans([t for t, _ in held], model)
    want = [(i, s) for i, (_, spans) in enumerate(held) for s in spans if s[0] in ("ip", "phone", "secret")]
    hit = sum(s in found[i] for i, s in want)
    false = sum(s[0] in ("ip", "phone", "secret") and s not in held[i][1]
                for i, f in enumerate(found) for s in f)
    assert hit >= 0.85 * len(want) and false <= 0.1 * len(want)
    # A number beside another: the base pattern takes both and drops them.
    t = "call +1 (269) 555-3296 4111111111111111 now"
    assert not [s for s in I.base_spans(t) if s[0] == "phone"]
    assert ("phone", 5, 22) in I.field_spans([t], model)[0]
    assert I.field_spans(["plain words only, nothing else"], model) == [[]]


def test_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = I.find(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = [tuple(s) for s in r["base"]]
        spans = [tuple(s) for s in r["spans"]]
        assert base == naive(texts[r["doc_id"]]) and set(base) <= set(spans)
        for s in set(spans) - set(base):
            assert all(s[2] <= a or b <= s[1] for _, a, b in base)
    masked = I.mask(docs).collect()
    for r in masked:
        assert not naive(r["text"])


def test_hard_rows(spark):
    rows = I.find(hard(spark).coalesce(1)).collect()
    texts = [r["text"] for r in hard(spark).collect()]
    assert [[tuple(s) for s in r["base"]] for r in rows] == [naive(t) for t in texts]
    out = I.mask(hard(spark).coalesce(1))
    assert out.columns == hard(spark).columns
    got = out.collect()
    assert [r["text"] is None for r in got] == [t is None for t in texts]
    assert got[-1]["text"] == "[IP] [EMAIL] [PHONE] [CARD]"
    assert I.find(none(spark)).collect() == [] and I.mask(none(spark)).collect() == []


def test_mask_overlaps():
    assert I.masked("ab cd ef", [("x", 0, 2), ("y", 1, 5), ("z", 6, 8)]) == "[X] [Z]"


def test_addresses_are_found_whole():
    """Addresses without digits and of many parts: seen to both ends, also without an @."""
    model = I.train(I.training_rows())
    r = random.Random(21)
    names = ["jane", "john", "smith", "maria", "peter", "office", "example", "mail", "post", "web", "info"]
    texts = []
    for _ in range(300):
        local = ".".join(r.choice(names) for _ in range(r.randint(1, 5)))
        domain = ".".join([r.choice(names) for _ in range(r.randint(1, 4))] + [r.choice(["com", "org"])])
        texts.append(("write to ", local + r.choice([" @ ", " (at) "]) + domain, " today and order"))
    texts += [("mail ", "john.smith @ mail.example.com", " today"), ("mail ", "jane (at) example.org", " today")]
    found = I.field_spans([a + s + b for a, s, b in texts], model)
    hit = [("email", len(a), len(a + s)) in f for (a, s, _), f in zip(texts, found)]
    assert sum(hit) >= 0.95 * len(hit) and hit[-2:] == [True, True]
    plain = ["we met at the house, at ten. The dot and the order", "look at that. Then (at home) order mail"]
    assert I.field_spans(plain, model) == [[], []]


def test_long_octets():
    text = "0" * 5000 + ".0.0.1 and " + "9" * 5000 + ".1.1.1"
    assert [s for s in I.base_spans(text) if s[0] == "ip"] == [("ip", 0, 5006)]
