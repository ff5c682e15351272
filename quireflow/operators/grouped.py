"""Sequential work on groups of rows, many groups to a batch.

applyInPandas pays some milliseconds for each group; pages hold a few dozen boxes, and there are many pages. Here rows
are dealt and sorted by key once, and a Python worker goes through the groups of each Arrow batch as NumPy slices. A
group is held whole by one task: it is a page's worth of boxes, never a corpus-wide key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

Arrays = dict[str, np.ndarray]


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of equal keys begins."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.nonzero(change)[0]


def map_tables(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over tables of whole groups, sorted by keys and `order`, with the groups' starts and stops in them. A window deals
    and sorts the rows: those that lie by key already, as after a join, are not shuffled again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            starts = _starts(table, keys)
            if len(starts) > 1 and (ready := fn(table.slice(0, int(starts[-1])), starts[:-1], starts[1:])) is not None:
                yield ready
            held = table.slice(int(starts[-1])).combine_chunks()
        if held is not None and (ready := fn(held, np.array([0]), np.array([held.num_rows]))) is not None:
            yield ready

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[Arrays], Arrays], out: dict[str, str], schema: str) -> DataFrame:
    """fn over each group's columns, sorted by `order`, as arrays without nulls; it returns arrays of `out`'s columns
    (name to Arrow type), a row each. The result has the keys before them."""
    names = [c for c in df.columns if c not in keys]

    def done(table: pa.Table, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch | None:
        values = {n: table.column(n).to_numpy() for n in names}
        rows, parts = [], {n: [] for n in out}
        for s, e in zip(starts.tolist(), stops.tolist()):
            found = fn({n: v[s:e] for n, v in values.items()})
            count = len(next(iter(found.values())))
            rows.append(np.full(count, s, dtype=np.int64))
            for n in out:
                parts[n].append(found[n])
        at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        if not len(at):
            return None
        columns = [table.column(k).combine_chunks().take(pa.array(at)) for k in keys]
        columns += [pa.array(np.concatenate(parts[n])).cast(kind) for n, kind in out.items()]
        return pa.RecordBatch.from_arrays(columns, [*keys, *out])

    return map_tables(df, keys, order, done, schema)
