"""Columns computed row after row within a key, for rules that depend on what came before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string


def fold_rows(rows: DataFrame, keys: list[str], order: list[str | Column], read: list[str], adds: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """rows with the columns of adds (a DDL string), in the given order within each key.

    start() makes the state of a key and returns a step, which gets the values of the columns read, row by row,
    and returns the values of adds. A key's rows stream through one task in batches: only its
    state is held, never its rows. Rows of equal order come in any order; null keys are a key; no rows give none.
    """
    adds_type = _parse_datatype_string(adds)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds = [to_arrow_type(f.dataType) for f in adds_type.fields]
    names = [*rows.columns, *[f.name for f in adds_type.fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for key, values in zip(zip(*[batch.column(k).to_pylist() for k in keys]), zip(*[batch.column(c).to_pylist() for c in read])):
                if key != now:
                    now, step = key, start()
                out.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]], names=names)

    return dealt.mapInArrow(run, StructType([*rows.schema.fields, *adds_type.fields]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Of batches in order of keys the rows of one key after another, each as a table: one key's rows are held at a time."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        found = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        cuts = [0, *[i for i in range(1, len(found)) if found[i] != found[i - 1]], len(found)]
        for low, high in zip(cuts, cuts[1:]):
            if parts and found[low] != now:
                yield pa.Table.from_batches(parts)
                parts = []
            now = found[low]
            parts.append(batch.slice(low, high - low))
    if parts:
        yield pa.Table.from_batches(parts)


def together(tables: Iterator[pa.Table], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Small tables as batches of about so many rows: a batch costs more than its rows where groups are small."""
    held, n = [], 0
    for table in tables:
        held.append(table)
        n += table.num_rows
        if n >= rows:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()
