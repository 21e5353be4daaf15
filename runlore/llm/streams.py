"""Groups of rows that arrive sorted in Arrow batches, one group at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Columns = dict[str, np.ndarray | tuple[np.ndarray, np.ndarray] | list]


def _column(values: pa.Array):
    """Numbers as an array, lists of numbers as (flat values, lengths), anything else as a list."""
    if pa.types.is_list(values.type) and pa.types.is_primitive(values.type.value_type):
        flat = values.flatten().to_numpy(zero_copy_only=False)
        return flat, pc.list_value_length(values).to_numpy(zero_copy_only=False)
    if pa.types.is_integer(values.type) and not values.null_count:
        return values.to_numpy(zero_copy_only=False)
    return values.to_pylist()


def _cut(column, ends: dict, low: int, high: int):
    if isinstance(column, tuple):
        flat, lengths = column
        at = ends.setdefault(id(lengths), np.concatenate([[0], np.cumsum(lengths)]))
        return flat[at[low] : at[high]], lengths[low:high]
    return column[low:high]


def _joined(pieces: list):
    if len(pieces) == 1:
        return pieces[0]
    if isinstance(pieces[0], tuple):
        return tuple(np.concatenate([p[i] for p in pieces]) for i in (0, 1))
    if isinstance(pieces[0], np.ndarray):
        return np.concatenate(pieces)
    return [x for p in pieces for x in p]


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[Columns]:
    """The columns of each run of rows with equal ``keys``; only the open group is held.

    Rows must be sorted so that equal keys are neighbours. Key columns hold no nulls.
    """
    open_: list[Columns] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for name in keys:
            values = batch.column(name)
            change[1:] |= pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        change[0] = last is not None and first != last
        last = tuple(batch.column(k)[-1].as_py() for k in keys)
        columns = {n: _column(batch.column(n)) for n in batch.schema.names}
        ends: dict = {}
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(starts, starts[1:]):
            if change[low] and open_:
                yield {n: _joined([p[n] for p in open_]) for n in columns}
                open_ = []
            if high > low:
                open_.append({n: _cut(c, ends, low, high) for n, c in columns.items()})
    if open_:
        yield {n: _joined([p[n] for p in open_]) for n in open_[0]}
