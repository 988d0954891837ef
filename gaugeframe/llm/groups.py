"""Streaming over groups inside one task of a partition sorted by its keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def complete_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the n + 1 row offsets of the groups.

    The rows must come sorted by ``keys`` (integers without nulls).  At most
    one batch and the largest group are in memory.
    """

    def edges(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            v = t[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    rest: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        if rest and all(rest[-1][k][-1].as_py() == t[k][0].as_py() for k in keys):
            e = edges(t)
            if not len(e):  # the open group goes on through the whole batch
                rest.append(t)
                continue
            whole = pa.concat_tables([*rest, t.slice(0, e[0])]).combine_chunks()
            yield whole, np.array([0, whole.num_rows])
            t = t.slice(e[0])
        elif rest:
            whole = pa.concat_tables(rest).combine_chunks()
            yield whole, np.array([0, whole.num_rows])
        e = edges(t)
        last = int(e[-1]) if len(e) else 0
        if last:
            yield t.slice(0, last).combine_chunks(), np.r_[0, e]
        rest = [t.slice(last)]
    if rest:
        whole = pa.concat_tables(rest).combine_chunks()
        yield whole, np.array([0, whole.num_rows])
