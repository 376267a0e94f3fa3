"""Users' own functions of groups that no group can overflow (F2).

A grouped map hands a function one whole group; a group holding a third of the table then has to
fit in one task. Here the function comes in parts, as an aggregate does:

* ``partial(frame) -> state``: what some rows of one group (a pandas frame) come to;
* ``merge(state, state) -> state``: in any order and any grouping;
* ``finish(key, state) -> rows``: the group's result, tuples of the columns of ``schema``.

``combine_groups`` runs ``partial`` on the rows that a group has in one Arrow batch, merges states inside the
task, then over (key, salt) and at last over the key. Only states are shuffled; both merges read
sorted states one after another, so a task holds a batch and a few states whatever the size of a group.

``map_with_groups`` is the form for functions that give a row or more per row and need to know
their group: ``combine_groups`` first says what is to be known of a group, then each batch of
rows, of any groups and in any order, is mapped with it at hand.

Defined cases: rows with a null (or NaN) in a key belong to no group, as in a grouped map of
pandas; ``partial`` gets integers as nullable integers, so nulls turn none into a float; an empty table has no groups;
a state is any Python object that pickles, of a size that the functions have to bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ..session import materialize
from .joins import fits_broadcast, salted_join

#: States that a task holds before it passes them on.
HELD = 4096
#: Rows of a result batch.
ROWS = 10_000


def _column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def combine_groups(df: DataFrame, keys: list[str], partial: Callable, merge: Callable,
                   finish: Callable, schema: str, salts: int | None = None) -> DataFrame:
    """``keys`` and the columns of ``schema``: ``finish`` of every group's merged state.

    ``salts`` (default: the shuffle partitions) is how many sub-groups a group's states are
    merged in before they are merged by key.
    """
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = salts or n
    keys, held_most, rows_most = list(keys), HELD, ROWS
    width = len(keys)
    key_fields = [StructField(f"k{i}", df.select(_column(k)).schema[0].dataType)
                  for i, k in enumerate(keys)]
    state_type = StructType([*key_fields, StructField("state", BinaryType())])
    salted_type = StructType([*key_fields, StructField("salt", IntegerType()),
                              StructField("state", BinaryType())])
    result = spark.createDataFrame([], schema).schema
    out_type = StructType([*key_fields, *[StructField(f"v{i}", f.dataType) for i, f in enumerate(result)]])
    state_arrow, salted_arrow, out_arrow = map(to_arrow_schema, (state_type, salted_type, out_type))
    nullable = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(),
                pa.int64(): pd.Int64Dtype()}

    def batch_of(rows, arrow):
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def partials(batches):
        import pickle

        held = {}

        def flushed():
            return batch_of([(*key, pickle.dumps(state)) for key, state in held.items()], state_arrow)

        for batch in batches:
            frame = batch.to_pandas(types_mapper=nullable.get)
            for key, part in frame.groupby(keys, sort=False):
                state = partial(part)
                held[key] = merge(held[key], state) if key in held else state
            if len(held) > held_most:
                yield flushed()
                held = {}
        if held:
            yield flushed()

    def folded(batches, by):
        """(key, state) of each run of rows that are equal in their first ``by`` columns."""
        import pickle

        key, state = None, None
        for batch in batches:
            for *new, raw in zip(*(batch.column(c).to_pylist() for c in [*range(by), batch.num_columns - 1])):
                if key == new:
                    state = merge(state, pickle.loads(raw))
                    continue
                if key is not None:
                    yield key, state
                key, state = new, pickle.loads(raw)
        if key is not None:
            yield key, state

    def by_salt(batches):
        import pickle

        rows = []
        for key, state in folded(batches, width + 1):
            rows.append((*key, pickle.dumps(state)))
            if len(rows) >= held_most:
                yield batch_of(rows, salted_arrow)
                rows = []
        if rows:
            yield batch_of(rows, salted_arrow)

    def by_key(batches):
        rows = []
        for key, state in folded(batches, width):
            for row in finish(tuple(key), state):
                rows.append((*key, *row))
                if len(rows) >= rows_most:
                    yield batch_of(rows, out_arrow)
                    rows = []
        if rows:
            yield batch_of(rows, out_arrow)

    names = [f.name for f in key_fields]
    states = df.dropna(subset=keys).mapInArrow(partials, state_type)
    if salts > 1:
        # A task's number spreads the states of a hot key, also where they are all equal.
        salted = states.select(*names, F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int").alias("salt"),
                               "state")
        states = (salted.repartition(n, *names, "salt").sortWithinPartitions(*names, "salt")
                        .mapInArrow(by_salt, salted_type).drop("salt"))
    done = states.repartition(n, *names).sortWithinPartitions(*names).mapInArrow(by_key, out_type)
    return done.toDF(*keys, *result.names)


def map_with_groups(df: DataFrame, keys: list[str], groups: DataFrame, fn: Callable,
                    schema: str) -> DataFrame:
    """``fn(frame) -> frame`` over batches of the rows of ``df``, each with its group's columns of ``groups``.

    ``groups`` has a row per key, as ``combine_groups`` gives it; rows without one are left out.
    Its rows come by broadcast where their measured bytes are few, else by a salted join. ``fn`` gets frames as
    ``mapInPandas`` makes them.
    """
    def run(batches):
        for frame in batches:
            yield fn(frame)

    groups = materialize(groups)
    if fits_broadcast(groups):
        met = df.join(F.broadcast(groups), keys)
    else:
        met = salted_join(df, groups, keys)
    return met.mapInPandas(run, schema)
