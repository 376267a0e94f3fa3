"""Byte-level BPE by the tiktoken library, from a local file of ranks.

``encode`` gives a text's ids as the library gives them for the whole text. The library's pattern
engine backtracks over white space and holds a whole text's matches, so a long text is cut
first, only where no match of the pattern can reach across and none can look across:

* before white space that follows something else. White space stands in a match at its beginning
  only (or the match is nothing else), and nothing but a run of white space looks ahead;
* around the first n - 1 signs of a long run of n white-space signs that something follows (all
  n at the end of the text). The pattern makes them one match, whose ids come from an encoding that
  takes its input as a single match.

What lies between two cuts is given to the library as it is: a run of millions of letters is a single
match, which the library merges with a heap. ``decode`` gives bytes, not text: ids may end inside
a character, and cutting or joining lists of ids then loses nothing.

Defined cases: a null text is empty and has no ids; null ids decode to no bytes, and an id
without a rank raises; repeated rows and ids are each encoded on their own; an empty table gives an
empty table; signs that are no valid UTF-8 become U+FFFD, as they do for anyone who reads the text;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Texts up to this many code points are given to the library whole.
BLOCK = 1 << 16
#: White space of this length or more is cut out of a long text.
RUN = 1 << 10
# Unicode's White_Space, which the pattern's \s stands for. (Python's \s has four signs more.)
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{{RUN},}}")
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _blocks(text: str, lo: int, hi: int, block: int) -> Iterator[str]:
    """text[lo:hi] in parts of at least ``block`` code points, cut at the next safe place."""
    while hi - lo > block:
        m = _SAFE.search(text, lo + block, hi)
        if not m:
            break
        yield text[lo:m.start()]
        lo = m.start()
    yield text[lo:hi]


def split(text: str, block: int = BLOCK) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match): the parts of a text whose ids, one after another, are the text's."""
    if len(text) <= block:
        yield text, False
        return
    at = 0
    for m in _RUN.finditer(text):
        end = m.end() - (m.end() < len(text))
        for part in _blocks(text, at, m.start(), block):
            yield part, False
        yield text[m.start():end], True
        at = end
    for part in _blocks(text, at, len(text), block):
        yield part, False


class Codec:
    """text -> ids and ids -> bytes, of a file of ranks and a pattern."""

    def __init__(self, ranks_path: str, pattern: str, block: int = BLOCK):
        import tiktoken

        ranks = ranks_of(ranks_path)
        self.block = block
        self._whole = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._match = tiktoken.Encoding("match", pat_str=r"(?s:.+)", mergeable_ranks=ranks,
                                        special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> np.ndarray:
        """The ids, as unsigned 32-bit numbers."""
        parts = [(self._match if one else self._whole).encode_to_numpy(part, disallowed_special=())
                 for part, one in split(text, self.block) if part]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                    pa.array(np.concatenate(ids).view(np.int32)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row: the ids of the whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        codec = Codec(ranks_path, pattern)

        def run(batch):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            return {"doc_id": batch.column("doc_id"),
                    "ids": _lists([codec.encode((t or b"").decode("utf-8", "replace"))
                                   for t in texts])}

        return run

    return map_batches(rows, make, f"doc_id {kind}, ids array<int>", ("text",))


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids",
           out_col: str = "raw") -> DataFrame:
    """``rows`` with the bytes of ``ids_col`` under ``out_col``, which replaces a column of that name."""
    kept = [c for c in rows.columns if c != out_col]
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]

    def make():
        codec = Codec(ranks_path, pattern)

        def run(batch):
            return {**{c: batch.column(c) for c in kept},
                    out_col: [codec.decode(x or ()) for x in batch.column(ids_col).to_pylist()]}

        return run

    return map_batches(rows.select(*[F.col(f"`{c}`") for c in kept]), make,
                       ", ".join([*fields, f"`{out_col}` binary"]), (ids_col,))
