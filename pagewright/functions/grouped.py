"""Sequential work within groups, for what no window can express.

Rows are partitioned and sorted by their group, and a partition's groups pass as runs of rows through one
Arrow stream.  For many small groups this is far cheaper than one data frame a group.  Work gets a group as columns,
so that only what it looks at row by row becomes Python values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import struct

#: Output rows that leave Python together.
CHUNK = 8192

Columns = dict[str, list]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[Columns]:
    """Rows with equal keys that follow one another, as columns; a run may go on over batches."""
    held: tuple | None = None
    run: Columns = {}
    for b in batches:
        columns = b.to_pydict()
        at = 0
        for key, same in groupby(zip(*(columns[k] for k in keys), strict=True)):
            end = at + sum(1 for _ in same)
            if key != held:
                if held is not None:
                    yield run
                held, run = key, {c: [] for c in columns}
            for c, values in columns.items():
                run[c] += values[at:end]
            at = end
    if held is not None:
        yield run


def by_group(df: DataFrame, keys: list[str], order: list[str | Column], work: Callable[[Columns], Iterable[tuple]], schema: str, partition: list[str] | None = None) -> DataFrame:
    """``work`` on the ordered rows of each group of ``keys``, as columns; it gives tuples of ``schema`` (``name kind, ...``).

    ``partition``, a part of the keys, places the groups; a group is held in memory while it is worked on.
    """
    kinds = struct(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(kinds)

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else ((),) * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        out: list[tuple] = []
        for group in runs(batches, keys):
            out += work(group)
            if len(out) >= CHUNK:
                yield pack(out)
                out = []
        yield pack(out)

    return df.repartition(*(partition or keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, kinds)


def rows_of(group: Columns) -> list[dict]:
    """The group's rows, where work needs whole rows."""
    return [dict(zip(group, values, strict=True)) for values in zip(*group.values(), strict=True)]
