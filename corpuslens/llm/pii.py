"""Personal data: base patterns, and a linear-chain conditional random field over
word shapes that finds forms the patterns miss (numbers without a country code,
addresses with spaces, numbers side by side, keys and passwords).

Tokens are runs of letters and digits, runs of spaces and single other
characters; a token's shape is its kind (letters, digits, both) with its length and case. The field has
weights for the shapes at offsets -3..3 and for neighbouring pairs, and for
transitions. It is trained on the driver from a small labelled table (``TRAINING``, filled
in by a seeded rule) by gradient ascent, and decoded by Viterbi in numpy, many
sequences at a time. Its sequences are the maximal runs of tokens within REACH
tokens of one with a digit, an ``@`` or the word "at" or "dot", each grown to the blanks on both sides, so
that no address is cut; tokens farther away are outside by definition, so
whole texts are read but plain prose costs little. An address that is found is grown to the whole
local part before it and the whole domain behind it. What the field finds is checked
(digit counts, Luhn, parts up to 255) and added where no base span stands.

Base kinds, each leftmost and without overlaps: email, ip (parts up to 255), card (13-19
digits, Luhn), phone (9-15 digits). A match that fails its check is dropped and
not tried again. Every base pattern runs in time linear in the text.

Defined cases: a null text counts as empty (no spans); rows are independent, so repeated
rows repeat their result; an empty table gives an empty table; other columns of
the input are ignored by ``find`` and kept by ``mask``, whatever their names.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", "email", "ip", "card", "phone", "secret")
REACH = 4

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only: from inside it the same rest fails again.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: An address that lacks its local part, and what a domain goes on with.
_LEAD = re.compile(r"@|[(\[]at[)\]]")
_TAIL = re.compile(r"[A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++)*+")
_TRIGGER = re.compile(r"[0-9@]|\b(?:at|dot)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Matches of local part, @, domain: the local part is the run of its characters
    before an @, from the end of the last match at the earliest."""
    begin, at = 0, text.find("@")
    while at >= 0:
        head = text[begin:at]
        start = begin + len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        begin = m.end() if m else at + 1
        at = text.find("@", begin)


def _good(kind: str, s: str) -> bool:
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(
            len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    d = _digits(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 9 <= len(d) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind in the order of KINDS, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for kind, rx, sign in (("ip", _IP, "."), ("card", _CARD, ""), ("phone", _PHONE, "+")):
        if sign in text:
            out += [(kind, *m.span()) for m in rx.finditer(text) if _good(kind, m[0])]
    return out


# --- shapes -------------------------------------------------------------------

_N_SHAPES = 200
_EDGE = 199
#: Shapes of the words "at" and "dot" (code points of digits, which no single character's shape is).
_AT, _DOT = 48, 49
_OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
_N_FEATURES = len(_OFFSETS) * _N_SHAPES + 2 * _N_SHAPES * _N_SHAPES


def _char_kinds() -> np.ndarray:
    """0 space, 1 line end, 2 digit, 3 lower, 4 upper, 5 other; beyond ASCII: 3."""
    k = np.full(129, 5, np.uint8)
    for c in range(128):
        ch = chr(c)
        if ch in " \t":
            k[c] = 0
        elif ch in "\r\n":
            k[c] = 1
        elif "0" <= ch <= "9":
            k[c] = 2
        elif "a" <= ch <= "z":
            k[c] = 3
        elif "A" <= ch <= "Z":
            k[c] = 4
    k[128] = 3
    return k


_CHAR_KINDS = _char_kinds()


def shapes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, shape) of the tokens of a text, each in 0.._N_SHAPES-2."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(cp):
        return (np.empty(0, np.int64),) * 3
    kind = _CHAR_KINDS[np.minimum(cp, 128)]
    run = np.where((kind == 3) | (kind == 4), 2, kind)
    new = np.ones(len(cp), bool)
    new[1:] = (run[1:] != run[:-1]) | (run[1:] == 5) | (run[1:] == 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(cp))
    n, first = ends - starts, run[starts]
    upper = np.add.reduceat((kind == 4).astype(np.int64), starts)
    digits = np.add.reduceat((kind == 2).astype(np.int64), starts)
    case = np.where(upper == 0, 0, np.where(upper == n, 1, np.where(
        (upper == 1) & (kind[starts] == 4), 2, 3)))
    # Shapes 65-90 and 97-122: letters and digits together, with or without capitals, by length.
    shape = np.select(
        [first == 0, first == 1, (first == 2) & (digits == n), (first == 2) & (digits == 0),
         first == 2],
        [196 + (n > 1), np.full(len(n), 198), 175 + np.minimum(n, 20),
         127 + case * 12 + np.minimum(n, 12), np.where(upper > 0, 64, 96) + np.minimum(n, 26)],
        np.minimum(cp[starts], 127))
    shape = shape.astype(np.int64)
    low = np.where(cp < 128, cp | 32, 0)
    for word, own in (("at", _AT), ("dot", _DOT)):
        at = np.flatnonzero((first == 2) & (digits == 0) & (n == len(word)))
        same = np.ones(len(at), bool)
        for k, c in enumerate(word):
            same &= low[starts[at] + k] == ord(c)
        shape[at[same]] = own
    return starts, ends, shape


def features(shape: np.ndarray) -> np.ndarray:
    """(tokens, 9) feature numbers of a text's tokens."""
    pad = np.concatenate([np.full(3, _EDGE), shape, np.full(3, _EDGE)])
    n = len(shape)
    cols = [k * _N_SHAPES + pad[3 + o:3 + o + n] for k, o in enumerate(_OFFSETS)]
    at = len(_OFFSETS) * _N_SHAPES
    cols.append(at + pad[2:2 + n] * _N_SHAPES + shape)
    cols.append(at + _N_SHAPES * _N_SHAPES + shape * _N_SHAPES + pad[4:4 + n])
    return np.stack(cols, 1)


# --- the labelled table --------------------------------------------------------

# The small labelled table. Fields in braces are filled in by a seeded rule;
# those named after a label are spans of it, the rest are ordinary text.
TRAINING = (
    "{w} {w} {email} {w} {w}.",
    "{w}, {w} {w} {email}, {w}",
    "{w} <{email}> {w}: {w}",
    "{w} {W}: {email}. {W} {w}",
    "{W} {w} {ip} {w} {w} {w}",
    "{w} {w} {ip}, {w} {ip}. {W}",
    "{w} ({ip}) {w} {w}",
    "{w} {w} {card} {w} {w}, {w}.",
    "{W} {w} {card}. {W} {w}",
    "{w} {w} {phone} {w} {w}.",
    "{W}: {phone}, {w} {w} {w}",
    "{w}. {phone} {W} {w} {w}",
    "{w} {phone}. {W}. {w}",
    "{w} {w} {phone} {card} {w}",
    "{w} {phone} {w}. {ip} {w} {card}, {w}",
    "{W} {ip} {w} {ip}",
    "{w} {w} {email} {w} {w}",
    "{w}: {email}, {W} {w}",
    "{w} {w} at {w} {w}, {w} at {w}.",
    "{w} at {number} {w} (at {w}). {W} dot {w}",
    "{w} {w}, {secret} {w} {w}",
    "{W} {w} {secret}. {w}",
    "{w} {w} {w}, {w} {w}. {W} {w} {w}.",
    "{w} {year} {w} {w} {w}-{w} {w}.",
    "{w} {date} {w}, {time} {w} {w}",
    "{w} {w} {version} {w}. {W} {w}",
    "{w} {number} {w} {w}, {number} {w}.",
    "{w} {long} {w} {w}. {W}",
    "{W} {long}, {w} {long} {w}",
    "{w} {price} {w} {w} {w} ({year})",
    "{w} {year}-{year} {w}, {w} {date}.",
    "{w} @{w} {w} {w} # {n} {w}",
    "{w} {w} {n}. {W} {w}; {n}, {n}, {n}.",
    "{n} | {n} | {w} | {number} | {w}",
    "{w}### {w}%%% {n}*** {w}$$$ {w}&&&",
    "{w} {n}/{n} {w} {n}:{n} {w} - {number} - {w}",
    "{w}, {version}. {W} {date} {w} {w}!",
)
# Words that fill the labelled table, of four languages.
WORDS = ("the of and to that was with from there when house which les des une dans pour avec "
         "maison était où und der nicht über schön eine werden los para como niño casa después "
         "que del thing nation street order call mail server card paid today").split()


def _fill(field: str, r: random.Random) -> str:
    def d(n):
        return "".join(r.choice("0123456789") for _ in range(n))

    def word():
        return r.choice(WORDS)

    def name():
        return r.choice(["".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9))),
                         "mail", "post", "web"])

    def octet():
        return str(r.randint(1, 255))

    match field:
        case "w":
            return word()
        case "W":
            return word().capitalize()
        case "email":
            dom = f"{name()}{r.choice(['', d(1)])}{r.choice(['.example', '.mail', ''])}"
            if r.random() < 0.5:  # without a digit, of several parts
                local = r.choice("._-").join(name() for _ in range(r.randint(1, 4)))
                parts = [*(name() for _ in range(r.randint(1, 3))), r.choice(["com", "org", "net", "de"])]
                at = r.choice([" @ ", " @ ", "@ ", " @", " (at) ", " (at) ", "(at)", " [at] "])
                return local + at + (r.choice([" (dot) ", " [dot] "]) if at.strip()[0] in "[("
                                     and r.random() < 0.3 else ".").join(parts)
            return r.choice([f"{name()}.{d(2)}@{dom}.com", f"{name()}@{dom}.org",
                             f"{name()}_{name()}@{dom}.net", f"{name()} @ {dom}.com",
                             f"{name()}{d(2)} (at) {dom}.org", f"{name()}{d(2)} @ {dom}.com"])
        case "ip":
            return ".".join(octet() for _ in range(4))
        case "card":
            return r.choice(["4", "5"]) + r.choice([d(15), f"{d(3)} {d(4)} {d(4)} {d(4)}",
                                                    f"{d(3)}-{d(4)}-{d(4)}-{d(4)}"])
        case "phone":
            return r.choice([f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}",
                             f"({d(3)}) {d(3)}-{d(4)}",
                             f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}",
                             f"00{r.randint(10, 99)} {d(3)} {d(3)} {d(4)}", f"+{d(11)}",
                             f"({d(3)}) {d(3)} {d(4)}"])
        case "secret":
            key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
            hexa = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 18, 24, 32])))
            return r.choice([f"AKIA{key}", f"password={hexa}", f"token={hexa}", f"AKIA{key}",
                             f"password={hexa}"])
        case "year":
            return str(r.randint(1900, 2030))
        case "date":
            return r.choice([f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
                             f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}",
                             f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}"])
        case "time":
            return f"{r.randint(0, 23)}:{r.randint(10, 59)}"
        case "version":
            return r.choice([f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(2)}", f"v{d(1)}.{d(1)}"])
        case "price":
            return r.choice([f"${d(2)}.{d(2)}", f"{d(3)},{d(2)} €", f"{d(1)},{d(3)}"])
        case "long":
            return d(r.randint(7, 12))
        case "number":
            return d(r.randint(3, 6))
        case _:
            return d(r.randint(1, 2))


def training_rows(copies: int = 24, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans) rows: every line of TRAINING, ``copies`` times, filled in."""
    r, out = random.Random(seed), []
    for line in TRAINING * copies:
        text, spans = "", []
        for part in re.split(r"(\{\w+\})", line):
            if part[:1] == "{":
                part, field = _fill(part[1:-1], r), part[1:-1]
                if field in LABELS:
                    spans.append((field, len(text), len(text) + len(part)))
            text += part
        out.append((text, spans))
    return out


# --- the field -----------------------------------------------------------------


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def train(rows, rounds: int = 40, rate: float = 0.15, ridge: float = 1e-3):
    """(weights, transitions) that maximise the penalised likelihood of the labelled rows."""
    k = len(LABELS)
    data = []
    for text, spans in rows:
        starts, _, shape = shapes(text)
        y = np.zeros(len(starts), np.int64)
        for kind, a, b in spans:
            y[(starts >= a) & (starts < b)] = LABELS.index(kind)
        data.append((features(shape), y))
    n, t = len(data), max(len(y) for _, y in data)
    idx = np.zeros((n, t, 9), np.int64)
    gold = np.zeros((n, t), np.int64)
    on = np.zeros((n, t), bool)
    for i, (f, y) in enumerate(data):
        idx[i, :len(y)], gold[i, :len(y)], on[i, :len(y)] = f, y, True
    used, at = np.unique(idx[on], return_inverse=True)
    small = np.zeros((n, t, 9), np.int64)
    small[on] = at.reshape(-1, 9)
    w, tr = np.zeros((len(used), k)), np.zeros((k, k))
    mom = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    hot = np.eye(k)[gold] * on[..., None]
    gold_tr = np.zeros((k, k))
    both = on[:, 1:] & on[:, :-1]
    np.add.at(gold_tr, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for step in range(1, rounds + 1):
        e = w[small].sum(2)
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0]
        for j in range(1, t):
            a = _lse(alpha[:, j - 1, :, None] + tr, 1) + e[:, j]
            alpha[:, j] = np.where(on[:, j, None], a, alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            b = _lse(tr + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(on[:, j + 1, None], b, 0)
        z = _lse(alpha[:, -1], 1)
        post = np.exp(alpha + beta - z[:, None, None]) * on[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + tr + (e + beta)[:, 1:, None, :]
                      - z[:, None, None, None]) * both[..., None, None]
        gw = np.zeros_like(w)
        diff = hot - post
        for c in range(9):
            np.add.at(gw, small[..., c][on], diff[on])
        grads = (gw / n - ridge * w, (gold_tr - pair.sum((0, 1))) / n - ridge * tr)
        for p, g, m, v in ((w, grads[0], mom[0], mom[1]), (tr, grads[1], mom[2], mom[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    full = np.zeros((_N_FEATURES, k), np.float32)
    full[used] = w
    return full, tr.astype(np.float32)


def viterbi(scores: list[np.ndarray], tr: np.ndarray, cells: int = 1 << 17) -> list[np.ndarray]:
    """The best label sequence of each (tokens, labels) score matrix. Sequences of like
    length are decoded together, ``cells`` tokens at a time (one longer alone)."""
    out: list = [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(scores[order[hi]]) <= cells:
            hi += 1
        part = order[lo:hi]
        lens = np.array([len(scores[i]) for i in part])
        t, k = lens.max(), tr.shape[0]
        e = np.zeros((len(part), t, k), np.float32)
        for r, i in enumerate(part):
            e[r, :lens[r]] = scores[i]
        best = e[:, 0].copy()
        back = np.zeros((len(part), t, k), np.int8)
        for j in range(1, t):
            step = best[:, :, None] + tr
            live = (lens > j)[:, None]
            back[:, j] = np.where(live, step.argmax(1), np.arange(k))
            best = np.where(live, step.max(1) + e[:, j], best)
        at = best.argmax(1)
        path = np.zeros((len(part), t), np.int8)
        for j in range(t - 1, -1, -1):
            path[:, j] = at
            at = back[np.arange(len(part)), j, at]
        for r, i in enumerate(part):
            out[i] = path[r, :lens[r]]
        lo = hi
    return out


def _near(shape: np.ndarray) -> np.ndarray:
    """Whether a token is within REACH tokens of a digit token, an ``@``, "at" or "dot", or in one
    run without blanks with such a token."""
    hit = ((shape > 175) & (shape < 196)) | (shape == ord("@")) | (
        (shape > 64) & (shape < 91)) | ((shape > 96) & (shape < 123)) | (shape == _AT) | (shape == _DOT)
    c = np.concatenate([[0], np.cumsum(hit)])
    n, i = len(shape), np.arange(len(shape))
    near = c[np.minimum(i + REACH + 1, n)] > c[np.maximum(i - REACH, 0)]
    solid = shape < 196
    run = np.cumsum(~solid)
    return near | (solid & (np.bincount(run[near & solid], minlength=n + 1)[run] > 0))


def field_spans(texts: list[str], model) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text, checked, in order of start."""
    w, tr = model
    out: list[list] = [[] for _ in texts]
    seqs, where = [], []
    for i, text in enumerate(texts):
        if not _TRIGGER.search(text):
            continue
        starts, ends, shape = shapes(text)
        near = _near(shape)
        feats = features(shape)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], near, [0]])))
        for a, b in edge.reshape(-1, 2):
            seqs.append(w[feats[a:b]].sum(1))
            where.append((i, starts[a:b], ends[a:b], shape[a:b]))
    of, begin = -1, 0  # a text and the end of its last address
    for path, (i, starts, ends, shape) in zip(viterbi(seqs, tr), where):
        cut = np.flatnonzero(np.diff(np.concatenate([[0], path, [0]])))
        for a, b in zip(cut, cut[1:]):
            if not path[a]:
                continue
            kind, blank = LABELS[path[a]], shape >= 196
            while a < b and blank[a]:
                a += 1
            while b > a and (blank[b - 1] or shape[b - 1] in (33, 44, 46, 58, 59, 63)):
                b -= 1
            if a < b:
                s, e = int(starts[a]), int(ends[b - 1])
                if kind == "email":
                    if i != of:
                        of, begin = i, 0
                    if s < begin:
                        continue
                    s, e = _grown(texts[i], s, e, begin)
                    begin = e
                if _plausible(kind, texts[i][s:e]):
                    out[i].append((kind, s, e))
    return out


def _grown(text: str, s: int, e: int, begin: int) -> tuple[int, int]:
    """An address with the whole local part before it (at ``begin`` at the earliest) and all parts of
    its domain."""
    at = s
    if _LEAD.match(text, s):
        while at > begin and text[at - 1] in " \t":
            at -= 1
    first = at
    while first > begin and text[first - 1] in _LOCAL:
        first -= 1
    return first if first < at else s, _TAIL.match(text, e).end()


def _plausible(kind: str, s: str) -> bool:
    """Exact checks on what the field finds."""
    if kind == "email":
        return bool(re.search(r"(?:\.|[(\[]dot[)\]] ?)[A-Za-z]{2,}$", s) and re.search(r"@|\bat\b", s))
    if kind == "phone":  # a bare number without + or grouping is no phone number
        return 9 <= len(_digits(s)) <= 15 and bool(
            re.search(r"^\+[0-9]+$|[0-9]{2,}[ )-]+[0-9]{3,}[ -]+[0-9]{3,}", s))
    if kind == "secret":
        value = s.rpartition("=")[2]
        return len(value) >= 16 and bool(re.fullmatch(r"[A-Za-z0-9]+", value)
                                         and re.search("[0-9]", value))
    return _good(kind, s)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model=None) -> DataFrame:
    """A row per document: ``doc_id``, ``base`` and ``spans``, arrays of (kind, start, end) in
    code points, end exclusive, sorted by kind (the order of LABELS) and start. ``spans``
    has every base span and what the field adds where none of them stands."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    array = "array<struct<kind: string, start: bigint, end: bigint>>"
    shipped = _shipped(docs.sparkSession, model)

    def make():
        look = _finder(shipped)

        def run(batch):
            found = look([t or "" for t in batch.column("text").to_pylist()])
            return {"doc_id": batch.column("doc_id"),
                    **{c: [[dict(zip(("kind", "start", "end"), s)) for s in row] for row in got]
                       for c, got in zip(("base", "spans"), zip(*found))}}

        return run

    return map_batches(rows, make, f"doc_id {kind}, base {array}, spans {array}", ("text",))


def _shipped(spark, model):
    """The trained field as a broadcast: its size is fixed by the feature set (4 MB)."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model or train(training_rows())))


def _finder(shipped):
    import pickle

    model = pickle.loads(shipped.value)

    def look(texts: list[str]) -> list[tuple[list, list]]:
        out = []
        for text, more in zip(texts, field_spans(texts, model)):
            base = base_spans(text)
            taken = sorted((a, b) for _, a, b in base)
            added = [s for s in more if not any(a < s[2] and s[1] < b for a, b in taken)] \
                if taken else more
            out.append((base, sorted(base + added, key=lambda s: (LABELS.index(s[0]), s[1]))))
        return out

    return look


def masked(text: str, spans) -> str:
    """The text with each span (overlapping ones together) written as its kind in brackets."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, text_col: str = "text", model=None) -> DataFrame:
    """The documents with their personal data replaced (null texts stay null), columns kept."""
    shipped = _shipped(docs.sparkSession, model)
    names = docs.columns
    at = names.index(text_col)
    kept = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def make():
        look = _finder(shipped)

        def run(batch):
            texts = batch.column(at).to_pylist()
            found = look([t or "" for t in texts])
            cols = {f"c{i}": batch.column(i) for i in range(batch.num_columns)}
            cols[f"c{at}"] = [t and masked(t, spans) for t, (_, spans) in zip(texts, found)]
            return cols

        return run

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema))
    return map_batches(kept, make, schema, (f"c{at}",)).toDF(*names)
