"""Helpers shared by the training-data operators: scans, shared scratch tables,
Arrow batches cut by bytes, and hashes of words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast, salted_join
from ..session import ensure_checkpoint_dir

#: Texts are handled in groups of about this many bytes (one longer text is a group of its own).
GROUP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A given table; only the named columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: the
    plan runs once, the lineage ends, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(share: float | Column, *cols: str) -> Column:
    """Whether a row is in a sample of about ``share`` of all, by 63 bits of a hash of ``cols``: no share that
    a table can ask for rounds to nothing. ``share`` may be a column."""
    share = F.least(F.lit(1.0), share) if isinstance(share, Column) else F.lit(min(1.0, float(share)))
    return F.when(share >= 1.0, F.lit(True)).otherwise(
        F.shiftrightunsigned(F.xxhash64(*cols), 1) < F.floor(share * float(1 << 63)))


def hot_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", hot: int = 100_000) -> DataFrame:
    """Equi-join (inner or left) with a table that is unique in ``key``. Rows of keys that ``big`` holds
    more than ``hot`` times meet their partners by a broadcast, if these measure small, or salted; the others by
    a plain join. Where no key is hot, that is all. ``big`` is read twice or more: best a written table."""
    often = big.groupBy(key).agg(F.count(F.lit(1)).alias("_times")).where(F.col("_times") > hot).select(key)
    if not often.limit(1).count():
        return big.join(small, key, how)
    often = written(often, "hot")
    keys = F.broadcast(often) if fits_broadcast(often) else often
    partners = written(small.join(keys, key, "left_semi"), "partners")
    mine = big.join(keys, key, "left_semi")
    met = mine.join(F.broadcast(partners), key, how) if fits_broadcast(partners) \
        else salted_join(mine, partners, [key], how)
    return met.unionByName(big.join(keys, key, "left_anti").join(small, key, how))


def groups(batches: Iterator[pa.RecordBatch], text_cols: tuple[str, ...],
           limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about ``limit`` bytes of text (of lists: numbers of 4 bytes)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.zeros(batch.num_rows, np.int64)
        for c in text_cols:
            col = batch.column(c)
            n = pc.multiply(pc.list_value_length(col), 4) if pa.types.is_list(col.type) \
                else pc.binary_length(col)
            size += n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size + 64) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str,
                text_cols: tuple[str, ...] = (), limit: int = GROUP_BYTES) -> DataFrame:
    """``mapInArrow`` over groups of rows. ``make`` runs once a task and returns
    the function from a batch to a dict of column values."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        fn = None
        for batch in groups(batches, text_cols, limit):
            fn = fn or make()
            cols = fn(batch)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x := cols[f.name], pa.Array) and x.type == f.type
                 else pa.array(x, f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound (then forgotten and begun anew)."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-xorshift hash, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
