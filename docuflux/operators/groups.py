"""Ordered groups, many to a batch: one shuffle by the keys, then a pass over sorted partitions."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import attrgetter, itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docuflux.session import ship

#: Rows that a worker gathers before it hands them on, and characters of texts.
BATCH, CHARACTERS = 8192, 1 << 20


def by_group(rows: DataFrame, keys: list[str], order: list[str], function: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """function(rows of a group as dicts, in order) for each group of equal keys; its dicts are the result.

    A worker holds one group and a batch of results at a time. Null keys are a group of their own.
    """
    ship(rows.sparkSession)
    kind = T.StructType.fromDDL(schema)
    columns = [f.name for f in kind.fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        every = (row for batch in batches for row in batch.to_pylist())
        for _, group in groupby(every, key=itemgetter(*keys)):
            done += function(list(group))
            if len(done) >= BATCH:
                yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in columns} for r in done], schema=arrow)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in columns} for r in done], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, kind)


def stepped(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Callable[..., tuple]], extra: str) -> DataFrame:
    """rows with the columns `extra` added: start() begins a group of equal keys and gives a function
    that takes a row's `columns`, in order, and returns its values of `extra`.

    A worker holds a batch and what the function keeps, whatever a group's size; the other columns
    pass through as Arrow has them.
    """
    ship(rows.sparkSession)
    kind, places = T.StructType.fromDDL(extra), [rows.columns.index(c) for c in keys]
    own = [rows.columns.index(c) for c in columns]
    from pyspark.sql.pandas.types import to_arrow_schema

    added = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            groups = zip(*[batch.column(i).to_pylist() for i in places], strict=True)
            values = zip(*[batch.column(i).to_pylist() for i in own], strict=True)
            out = []
            for key, value in zip(groups, values, strict=True):
                if step is None or key != now:
                    now, step = key, start()
                out.append(step(*value))
            new = [pa.array(column, field.type) for column, field in zip(zip(*out, strict=True), added, strict=True)] if out else [pa.array([], f.type) for f in added]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added.names])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, T.StructType([*rows.schema.fields, *kind.fields]))


def flowed(rows: DataFrame, keys: list[str], order: list[str], function: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, dealt: bool = False) -> DataFrame:
    """function(rows of a group as named tuples, in order, one by one) for each group of equal keys; the
    tuples that it yields, in the order of `schema`, are the result. A worker holds a batch and what
    the function keeps, whatever a group's size. dealt: rows are together by the keys already, as
    after a window over them, and are not shuffled again."""
    ship(rows.sparkSession)
    kind, columns = T.StructType.fromDDL(schema), list(rows.columns)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = namedtuple("Row", columns)
        every = (row(*values) for batch in batches for values in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        made = (out for _, group in groupby(every, key=attrgetter(*keys)) for out in function(group))
        while done := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

    together = rows if dealt else rows.repartition(*keys)
    return together.sortWithinPartitions(*keys, *order).mapInArrow(work, kind)


def cut(rows: DataFrame, text: str, function: Callable[[str], list[str]], place: str, piece: str) -> DataFrame:
    """A row for each of function(text): the other columns, its place from 0, and the piece; null and
    empty texts give none. A worker holds a batch, one text's pieces and `CHARACTERS` of others."""
    ship(rows.sparkSession)
    others = [f for f in rows.schema.fields if f.name != text]
    kind = T.StructType([*others, T.StructField(place, T.IntegerType()), T.StructField(piece, T.StringType())])
    names = [f.name for f in others]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(batch: pa.RecordBatch, done: list[tuple]) -> pa.RecordBatch:
            at, places, pieces = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(at, pa.int32())).columns, pa.array(places, pa.int32()), pa.array(pieces, pa.string())], kind.names)

        for batch in batches:
            done, held = [], 0
            for i, value in enumerate(batch.column(batch.schema.get_field_index(text))):
                if whole := value.as_py():
                    for n, part in enumerate(function(whole)):
                        done.append((i, n, part))
                        held += len(part)
                if len(done) >= BATCH or held >= CHARACTERS:
                    yield handed(batch, done)
                    done, held = [], 0
            if done:
                yield handed(batch, done)

    return rows.mapInArrow(work, kind)
