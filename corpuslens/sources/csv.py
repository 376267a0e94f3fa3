"""CSV with quoted line breaks, read by as many tasks as the file has blocks.

Spark's own reader takes a file as one task when fields may hold line breaks, as it can't tell inside which field
a block begins. Quotes tell: each line's are counted, and a block begins inside a quoted field when the quotes of
its file's earlier blocks are odd in number.

1. Lines are read as text, which splits at any line. One aggregation gives a row a block: how many quotes.
2. Running parities of that table (a file's blocks in order) say how each block begins.
3. Lines are joined into records in the tasks that read them, nothing is shuffled. The lines before a block's first
   whole record, and the record that is open at its end, are fragments: two rows a block at most, which are
   joined in order of their blocks.
4. Records are parsed by ``from_csv``.

NULL is written as ``\\N``; a text that is that mark, or that with more backslashes before it, gets one more, which
reading takes away again, so NULL, ``''`` and every text are told apart.
"""

from __future__ import annotations

from csv import reader
from io import StringIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

NULL = "\\N"
OPTIONS = {"multiLine": "true", "escape": '"', "quote": '"', "nullValue": NULL,
           "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def marked(c: Column) -> Column:
    """A text as it is written: one that could be taken for NULL gets a backslash more."""
    return F.when(c.rlike(r"^\\+N$"), F.concat(F.lit("\\"), c)).otherwise(c)


def unmarked(c: Column) -> Column:
    return F.when(c.rlike(r"^\\\\+N$"), F.substring(c, 2, 1 << 30)).otherwise(c)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line) of a file, a folder or a pattern; lines end at a line feed only."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"))


def inside_blocks(rows: DataFrame) -> dict[str, set[int]]:
    """The blocks of each file that begin inside a quoted field. What reaches the driver, and each worker, is a
    number a block, that is 8 bytes for every 128 MB or so of the input."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    odd = rows.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = odd.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).where("inside")
    return {r["file"]: set(r["blocks"])
            for r in inside.groupBy("file").agg(F.collect_list("block").alias("blocks")).collect()}


WHOLE, END, MIDDLE, OPEN = range(4)


class _Block:
    """The lines of one block as they stream by."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.odd = file, block, inside
        self.begun = not inside  # whether the record that is open begins in this block
        self.head = block == 0  # whether it is the file's first
        self.held: list[str] = []

    def rows(self, records, part: int, head: bool) -> pa.RecordBatch:
        n = len(records)
        records = records if isinstance(records, pa.Array) else pa.array(records, pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(self.file), n), pa.repeat(pa.scalar(self.block, pa.int64()), n),
             pa.repeat(pa.scalar(part, pa.int32()), n), pa.repeat(pa.scalar(head), n), records],
            names=["file", "block", "part", "head", "record"])

    def add(self, line: pa.Array):
        """Records that are complete now."""
        line = line.cast(pa.string())
        odd = (np.cumsum(pc.count_substring(line, '"').to_numpy()) + self.odd) % 2 == 1
        self.odd = bool(odd[-1])
        ends = np.flatnonzero(~odd) + 1  # a record ends after each of these lines
        if not len(ends):
            self.held += line.to_pylist()
            return
        yield self.rows(["\n".join([*self.held, *line.slice(0, ends[0]).to_pylist()])],
                        WHOLE if self.begun else END, self.head and self.begun)
        if len(ends) > 1:
            yield self.rows(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), line), "\n"),
                            WHOLE, False)
        self.held, self.begun, self.head = line.slice(int(ends[-1])).to_pylist(), True, False

    def rest(self):
        """What the block leaves open."""
        if self.held:
            yield self.rows(["\n".join(self.held)], OPEN if self.begun else MIDDLE, self.head and self.begun)


def _joined(rows: DataFrame, inside: dict[str, set[int]]) -> DataFrame:
    """(file, block, part, head, record): WHOLE records; the END of a record of an earlier block; a block that is
    the MIDDLE of one; one that a block leaves OPEN. ``head``: the file's first."""
    known = rows.sparkSession.sparkContext.broadcast(inside)

    def run(batches):
        now = None
        for batch in batches:
            file, block = batch.column("file"), batch.column("block").to_numpy()
            names = file.dictionary_encode()
            code = names.indices.to_numpy()
            cut = np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, batch.num_rows]):
                if hi > lo:
                    place = names.dictionary[int(code[lo])].as_py(), int(block[lo])
                    if now is None or (now.file, now.block) != place:
                        yield from now.rest() if now else ()
                        now = _Block(*place, place[1] in known.value.get(place[0], ()))
                    yield from now.add(batch.column("line").slice(lo, hi - lo))
        yield from now.rest() if now else ()

    return rows.mapInArrow(run, "file string, block long, part int, head boolean, record string")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(head, record): the records of CSV files, empty lines left out; ``head`` marks each file's first."""
    rows = lines(spark, path)
    found = _joined(rows, inside_blocks(rows))
    whole = found.where(F.col("part") == WHOLE).select("head", "record")
    # An OPEN record is continued by what the next blocks begin with: two rows a block at most.
    order = Window.partitionBy("file").orderBy("block", "part")
    pieces = found.where(F.col("part") != WHOLE).withColumn(
        "which", F.sum(F.when(F.col("part") == OPEN, 1).otherwise(0)).over(order))
    mended = pieces.groupBy("file", "which").agg(
        F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("block", "part", "record"))).alias("parts")
    ).select("head", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(mended).withColumn("record", F.regexp_replace("record", "\r$", "")).where(
        F.col("record") != "")


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A CSV table with a header in each file. Columns go by their places; without a schema they are texts under the
    names of the header."""
    rows = records(spark, path)
    if schema is None:
        first = rows.where("head").select("record").first()
        names = next(reader(StringIO(first["record"], newline=""))) if first else []
        schema = StructType([StructField(n, StringType()) for n in names])
    text = StructType([StructField(f"_{k}", StringType()) for k in range(len(schema))])
    parsed = rows.where(~F.col("head")).select(F.from_csv("record", text.simpleString()[7:-1].replace(":", " "), OPTIONS).alias("r"))
    return parsed.select(*[
        (unmarked(F.col(f"r._{k}")) if f.dataType == StringType() else F.col(f"r._{k}").cast(f.dataType))
        .alias(f.name) for k, f in enumerate(schema)])


def write(df: DataFrame, writer_mode: str, path: str, partition_by: list[str] | None = None) -> None:
    """A table as CSV with a header in each file."""
    df = df.select(*[marked(F.col(f"`{f.name}`")).alias(f.name) if f.dataType == StringType() else F.col(f"`{f.name}`")
                     for f in df.schema])
    writer = df.write.mode(writer_mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.options(header="true", **OPTIONS).csv(path)
