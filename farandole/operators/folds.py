"""Ordered folds: a small rule over each group's rows, streamed in order.

Groups are shuffled by key and sorted; a task reads its rows once and holds one group's state,
never the group: what the rule keeps is all that memory has to bear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "date": pa.date32(), "double": pa.float64()}
#: Rows of an output batch.
OUT_ROWS = 10_000


def folded(rows: DataFrame, keys: list[str], order: list[str], rule: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """What the rule yields for each group: it gets the key and the group's other columns, in order."""
    rest = [c for c in rows.columns if c not in keys]
    fields = [pa.field(n, _TYPES[t]) for n, t in (part.split() for part in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out = len(keys), []
        lines = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        full = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))
        for key, group in groupby(lines, lambda r: r[:n]):
            for row in rule(key, (r[n:] for r in group)):
                out.append(row)
                if len(out) >= OUT_ROWS:
                    yield full()
                    out = []
        if out:
            yield full()

    return rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def paged(rows: DataFrame, keys: list[str], rule: Callable[[pa.Table], Iterator[list[pa.Array]]], schema: str) -> DataFrame:
    """The keys and what the rule yields, column by column, for each group's rows: one group is held at a time,
    and what it yields is passed on at once. Groups with a null key are left out."""
    rows = rows.dropna(subset=keys)
    told = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *[part.split()[0] for part in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def group() -> Iterator[pa.RecordBatch]:
            page = pa.Table.from_batches(held)
            for found in rule(page):
                lead = [pa.repeat(page[k][0], len(found[0])) for k in keys]
                yield pa.RecordBatch.from_arrays([*lead, *found], names=names)

        for batch in batches:
            first = 0
            for key, same in groupby(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)):
                n = sum(1 for _ in same)
                if held and key != at:
                    yield from group()
                    held.clear()
                at = key
                held.append(batch.slice(first, n))
                first += n
        if held:
            yield from group()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{told}, {schema}")
