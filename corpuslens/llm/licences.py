"""Licence scan: Aho-Corasick for notice phrases and identifier tags, a
shunting-yard parser for licence expressions.

A text is lower-cased (A-Z only) and reduced to words, runs of characters other
than ASCII punctuation, space and controls. One automaton finds every place where
the words of a phrase stand consecutively, overlapping places included, in one
pass over the whole text. Where the words of the identifier tag occur, the lines
that follow ``SPDX-License-Identifier:`` are parsed as expressions
(``or`` < ``and`` < ``with``, brackets) and evaluated: which licences they
name, and whether some choice needs permissive licences only.

Defined cases: a null text counts as empty (no words, no labels, score 0); rows
are independent, so repeated rows repeat their result; an empty table gives an
empty table; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
}
TAG = "spdx license identifier"
# First parts of identifiers of licences without copyleft.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc-by", "cc0", "bsl", "zlib", "unlicense", "0bsd")
NOT_PERMISSIVE = ("cc-by-nc", "cc-by-nd", "cc-by-sa")

_BINDS = {"or": 1, "and": 2, "with": 3}
_TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*|\S")

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, n_tags long, expressions array<string>, "
          "permissive boolean")


def permissive(label: str) -> bool:
    return label.startswith(PERMISSIVE) and not label.startswith(NOT_PERMISSIVE)


def parse(expression: str) -> list[str] | None:
    """Postfix form by the shunting-yard rule; None where it is no expression."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether an operand must come next
    for tok in _TOKEN.findall(expression):
        low = tok.lower()
        if low in _BINDS:
            if operand:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif tok == "(":
            if not operand:
                return None
            held.append(tok)
        elif tok == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif tok[0].isalnum() and operand:
            out.append(low)
            operand = False
        else:
            return None
    if operand:
        return None
    while held:
        if (op := held.pop()) == "(":
            return None
        out.append(op)
    return out


def evaluate(postfix: list[str]) -> tuple[set[str], bool] | None:
    """(licences named, whether a choice of permissive licences meets it). An
    exception (right of ``with``) must be a plain name; it is part of the label."""
    stack: list[tuple[set[str], bool, str]] = []
    for tok in postfix:
        if tok not in _BINDS:
            stack.append(({tok}, permissive(tok), tok))
            continue
        b, a = stack.pop(), stack.pop()
        if tok == "with":
            if not (a[2] and b[2]):
                return None
            name = f"{a[2]} with {b[2]}"
            stack.append(({name}, a[1], name))
        elif tok == "and":
            stack.append((a[0] | b[0], a[1] and b[1], ""))
        else:
            stack.append((a[0] | b[0], a[1] or b[1], ""))
    return stack[0][:2]


def without_ending(line: str) -> str:
    """A line without the end of a comment, and the white space around that."""
    line = line.rstrip()
    for end in ("*/", "-->", "*)"):
        if line.endswith(end):
            return line[:-len(end)].rstrip()
    return line


def _scanner():
    """The function from a batch of texts to the columns of SCHEMA."""
    import ahocorasick

    phrases = {**BASE, **NOTICES, TAG: ""}
    auto = ahocorasick.Automaton()
    for p in phrases:
        auto.add_word(f" {p} ", p)
    auto.make_automaton()
    n_words = {p: len(p.split()) for p in phrases}
    keep = {ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"}
    to = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in keep else 32 for b in range(256))

    def run(batch: pa.RecordBatch) -> dict:
        out = {f.split()[0]: [] for f in SCHEMA.split(", ")}
        for raw in batch.column("text").cast(pa.binary()).to_pylist():
            words = (raw or b"").translate(to).split()
            line = b" " + b" ".join(words) + b" "
            base, starts, names, n_other, tagged = set(), [], set(), 0, False
            before = counted = 0
            for end, p in auto.iter(line.decode("latin-1")):
                if p == TAG:
                    tagged = True
                    continue
                names.add(phrases[p])
                if p in BASE:
                    base.add(phrases[p])
                    # Words up to the end, of which the phrase's are the last.
                    before += line.count(b" ", counted, end + 1)
                    counted = end + 1
                    starts.append(before - n_words[p] - 1)
                else:
                    n_other += 1
            found, choices = [], []
            for m in _TAG_LINE.finditer(raw.decode("utf-8", "replace")) if tagged else ():
                postfix = parse(without_ending(m[1]))
                got = postfix and evaluate(postfix)
                if got:
                    found.append(" ".join(postfix))
                    names |= got[0]
                    choices.append(got[1])
            if not choices and names:
                choices = [all(map(permissive, names))]
            for k, v in (
                ("n_words", len(words)), ("n_base", len(starts)),
                ("first_word", min(starts, default=None)), ("last_word", max(starts, default=None)),
                ("base_labels", ",".join(sorted(base))), ("labels", ",".join(sorted(names))),
                ("score", 1.0 - 0.5 ** (len(starts) + n_other + 3 * len(found))),
                ("n_tags", len(found)), ("expressions", found),
                ("permissive", all(choices) if choices else None),
            ):
                out[k].append(v)
        return out

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id under ``doc_id`` and the columns of SCHEMA.

    ``score`` is 1 - 0.5^(phrase places + 3 x parsed tags). ``expressions`` are in
    postfix. ``permissive`` is null where no licence is named.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        run = _scanner()
        return lambda batch: {"doc_id": batch.column("doc_id"), **run(batch)}

    return map_batches(rows, make, f"doc_id {kind}, {SCHEMA}", ("text",))
