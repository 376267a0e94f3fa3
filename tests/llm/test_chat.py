import hashlib
import random
from collections import defaultdict

import public_tokenizers as P

from corpuslens.llm import chat as C
from corpuslens.llm.queries import HOSTILE, op2_chat

from ..conftest import SF_SMALL

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, node string, path int, depth string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_escape_is_reversible():
    r = random.Random(3)
    parts = ["[", "]", "<", "/", "\\", "INST", "[INST]", "[/INST]", "</s>", "[\\INST]", "<\\\\/s>", "a", "\n"]
    for _ in range(5000):
        turns = [("".join(r.choice(parts) for _ in range(r.randint(0, 7))),
                  "".join(r.choice(parts) for _ in range(r.randint(0, 7)))) for _ in range(r.randint(1, 3))]
        for s in (x for t in turns for x in t):
            assert C.unescape(C.escape(s)) == s
            assert not any(c in C.escape(s) for c in (C.OPEN, C.CLOSE, C.END))
        assert C.turns_of("".join(f"{C.OPEN}{C.escape(a)}{C.CLOSE}{C.escape(b)}{C.END}"
                                  for a, b in turns)) == turns


def contract(convs):
    """What each conversation must give, from its turns."""
    out = {}
    for i, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[i] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def grouped(rows):
    convs = defaultdict(list)
    key = lambda t: tuple((x is not None, x if x is not None else 0) for x in t[1:2]) + (t[2] or "", t[3] or "")
    for r in sorted(rows, key=key):
        convs[r[0]].append((r[2] or "", r[3] or ""))
    return convs


def check_trees(nodes, members):
    """Tokens once, stretches disjoint, positions and ancestors as the paths say."""
    by = {bytes(r["node"]): r for r in nodes}
    assert len(by) == len(nodes)
    lay = defaultdict(list)
    for r in nodes:
        assert r["n_tokens"] == len(r["ids"]) // 4
        lay[bytes(r["tree"])].append((r["offset"], r["offset"] + r["n_tokens"]))
    for spans in lay.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    used = set()
    for m in members:
        path = [by[bytes(x)] for x in m["path"]]
        used |= {bytes(r["node"]) for r in path}
        at, before = 0, set()
        for d, r in enumerate(path):
            assert r["depth"] == d and r["position"] == at and bytes(r["tree"]) == bytes(path[0]["node"])
            assert (bytes(r["parent"]) == bytes(path[d - 1]["node"])) if d else r["parent"] is None
            assert {x for a, b in r["attends"] for x in range(a, b)} == before
            before |= set(range(r["offset"], r["offset"] + r["n_tokens"]))
            at += r["n_tokens"]
    assert used == set(by)
    # Depth first: a subtree is one stretch, so a node follows its parent or a finished sibling.
    order = sorted(nodes, key=lambda r: (bytes(r["tree"]), r["offset"]))
    stack = []
    for r in order:
        while stack and stack[-1] != (bytes(r["parent"]) if r["parent"] is not None else None):
            stack.pop()
        assert bool(stack) == (r["parent"] is not None)
        stack.append(bytes(r["node"]))


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)]
    want = contract(grouped(rows))
    got = op2_chat(spark, SF_SMALL).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == want and len(got) == len(want)
    for r in got:
        assert r["formatted_chars"] > r["loss_chars"]


def test_shared_turns(spark):
    r, rows = random.Random(5), []
    for c in range(60):
        text = "s"
        for t in range(r.randint(1, 6)):
            text += r.choice("ab") if r.random() < 0.5 else ""
            rows.append((c, t, ["user", "assistant"][t % 2], f"hello {text} [INST] wörld"))
    rows += [(c, t, "user", "the same first turn") for c in range(100, 130) for t in range(2)]
    rows += [(200, t, "user", f"turn {t}") for t in range(150)]
    rows += [(None, 0, None, None), (None, 1, "assistant", ""), (300, None, "user", "x"),
             (300, 0, "user", "y"), (300, 0, "user", "y"), (301, 0, "assistant", None)]
    df = spark.createDataFrame([(*x, "n", 1, "d") for x in rows], SCHEMA).repartition(4)
    nodes, members = C.trees(df, RANKS, JSON)
    check_trees(nodes.collect(), members.collect())
    back = C.read_back(nodes, members, RANKS).collect()
    want = contract(grouped(rows))
    assert len(back) == len(want)
    for x in back:
        turns = [(t["role"], t["text"]) for t in x["turns"]]
        loss = "".join(x["loss"])
        assert (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss)) == want[x["conv_id"]]
    assert nodes.count() < len(rows)
    none = spark.createDataFrame([], SCHEMA)
    nodes, members = C.trees(none, RANKS, JSON)
    assert nodes.collect() == [] and members.collect() == [] and C.read_back(nodes, members, RANKS).collect() == []
