"""Harmonic packing: documents into training sequences without padding.

A document's token ids, with an end id, give whole sequences of the capacity C and a remainder of r < C
tokens. Remainders are partitioned by length into reciprocal classes: class k = C // r holds those of
more than C / (k + 1) and at most C / k tokens, and fills bins with a fixed count, k whole remainders to a
bin. Each task fills its own bins as the rows stream by: nothing is shuffled, and a task holds at most
the open bins of the classes that occur (fewer than 6C tokens in all).

What a full bin leaves free, less than C / 2, is filled by a cut of a filler: a remainder that was set
aside, whenever fewer than C tokens of such are in stock, and is used up bit by bit. So a remainder is
either one whole piece or a filler in a few pieces, and a bin costs one cut, or two. A bin waits while the
stock is too small for it.

What is open at the task's end is laid end to end, longest first, and cut at every C; the last part is
cut into powers of two, which need no padding either (down to ``least`` tokens; the last sequence is then
padded).

The sequence id is (partition << 40) + bin, a function of the input's splits, so a
task run again gives the same rows.

Defined cases: a null text is empty (one piece, the end id alone); repeated rows and
ids are packed each on their own; an empty table gives an empty table; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import BLOCK, split
from .common import groups

SCHEMA = ("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long")


def encoder(ranks_path: str, json_path: str, special: bool = False):
    """text -> ids of the byte-level BPE. The ``.tiktoken`` file holds the same vocabulary
    as the ``.json`` and is read by a faster library; a text on which that one
    fails goes to ``tokenizers``. With ``special``, the special tokens of the ``.json`` that stand
    in a text get their own ids, as ``tokenizers`` gives them unless told otherwise; without, they
    are cut up as any other text."""
    import json
    import re

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=ranks, special_tokens={})
    plain = []
    own = {}
    if special:
        with open(json_path, encoding="utf-8") as f:
            own = {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}
    cut = re.compile(f"({'|'.join(map(re.escape, sorted(own, key=len, reverse=True)))})")

    # The same ids for a text that is a single match (a long run of white space).
    single = tiktoken.Encoding("match", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def ordinary(text: str) -> list[int]:
        if len(text) <= BLOCK:
            return fast.encode_ordinary(text)
        return [i for part, one in split(text) for i in (single if one else fast).encode_ordinary(part)]

    def encode(text: str) -> list[int]:
        try:
            if not any(t in text for t in own):
                return ordinary(text)
            # Every other part is a special token.
            parts = cut.split(text)
            return [i for k, part in enumerate(parts)
                    for i in ([own[part]] if k % 2 else ordinary(part))]
        except (KeyboardInterrupt, SystemExit, GeneratorExit):
            raise
        except BaseException:  # the library's own limits; its panics are no Exception
            if not plain:
                from tokenizers import Tokenizer

                plain.append(Tokenizer.from_file(json_path))
                plain[0].encode_special_tokens = not special
            return plain[0].encode(text, add_special_tokens=False).ids

    return encode


def tail(n: int, least: int = 1) -> list[int]:
    """Descending powers of two that sum to n, of at least ``least``, and what is left after them."""
    out = []
    while n:
        size = 1 << (n.bit_length() - 1)
        size = size if size >= least else n
        out.append(size)
        n -= size
    return out


class Bins:
    """The open bins of one task; ``add`` and ``close`` yield (piece, sequence id,
    offset, sequence length). A piece is (document id, start, length, ids, document tokens)."""

    def __init__(self, capacity: int, first_id: int, least: int = 1):
        self.capacity, self.next_id, self.least = capacity, first_id, least
        self.open: dict[int, list] = defaultdict(list)
        self.fillers: deque[tuple] = deque()
        self.stock = 0
        self.waiting: list[list] = []

    def _emit(self, pieces: list) -> Iterator[tuple]:
        total, at = sum(p[2] for p in pieces), 0
        for p in pieces:
            yield p, self.next_id, at, total
            at += p[2]
        self.next_id += 1

    @staticmethod
    def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, length, ids, total = piece
        return ((doc, start, n, ids[:4 * n], total), (doc, start + n, length - n, ids[4 * n:], total))

    def _filled(self) -> Iterator[tuple]:
        """Bins that wait, as far as the stock fills them."""
        while self.waiting:
            free = self.capacity - sum(p[2] for p in self.waiting[0])
            if free > self.stock:
                return
            pieces = self.waiting.pop(0)
            self.stock -= free
            while free:
                piece = self.fillers.popleft()
                if piece[2] > free:
                    piece, rest = self._cut(piece, free)
                    self.fillers.appendleft(rest)
                pieces.append(piece)
                free -= piece[2]
            yield from self._emit(pieces)

    def add(self, document: tuple) -> Iterator[tuple]:
        """A whole document."""
        while document[2] > self.capacity:
            piece, document = self._cut(document, self.capacity)
            yield from self._emit([piece])
        if document[2] == self.capacity:
            yield from self._emit([document])
        elif self.stock < self.capacity:
            self.fillers.append(document)
            self.stock += document[2]
            yield from self._filled()
        else:
            k = self.capacity // document[2]
            held = self.open[k]
            held.append(document)
            if len(held) == k:
                self.waiting.append(self.open.pop(k))
                yield from self._filled()

    def close(self) -> Iterator[tuple]:
        """Everything that is left."""
        rest = [*self.fillers, *(p for held in (*self.open.values(), *self.waiting) for p in held)]
        rest.sort(key=lambda p: -p[2])
        left = sum(p[2] for p in rest)
        goals = [self.capacity] * (left // self.capacity) + tail(left % self.capacity, self.least)
        rest = deque(rest)
        for goal in goals:
            pieces = []
            while goal:
                piece = rest.popleft()
                if piece[2] > goal:
                    piece, more = self._cut(piece, goal)
                    rest.appendleft(more)
                pieces.append(piece)
                goal -= piece[2]
            yield from self._emit(pieces)


def pack(docs: DataFrame, ranks_path: str, json_path: str, capacity: int = 1024, end_id: int = 0,
         least: int = 1, id_col: str = "doc_id", text_col: str = "text",
         special: bool = True) -> DataFrame:
    """A row per piece: ``doc_id`` and the columns of SCHEMA; ``ids`` holds the piece's
    ids as little-endian unsigned 32-bit numbers. ``capacity`` is a power of two. The ids are those of
    ``tokenizers`` with ``add_special_tokens=False`` (``special``: see ``encoder``)."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {SCHEMA}"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        from pyspark import TaskContext

        encode, bins = None, Bins(capacity, TaskContext.get().partitionId() << 40, least)

        def batch_of(found: list) -> pa.RecordBatch:
            cols = zip(*((p[0], p[1], p[2], p[3], p[4], s, at, n) for p, s, at, n in found))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in groups(batches, ("text",)):
            encode = encode or encoder(ranks_path, json_path, special)
            found: list = []
            for doc, text in zip(batch.column("doc_id").to_pylist(),
                                 batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                found += bins.add((doc, 0, len(ids), ids.tobytes(), len(ids)))
            if found:
                yield batch_of(found)
        if found := list(bins.close()):
            yield batch_of(found)

    return rows.mapInArrow(run, schema)
