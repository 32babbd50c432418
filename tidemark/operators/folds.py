"""A fold over each key's rows in order, in Arrow batches: many short keys in one batch, a long key piece by piece.

One call into pandas for each key costs more than the steps of a short key do,
and holds all rows of a long one. Here a task reads its sorted rows as they
come and holds one batch and one key's state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

TYPES = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}
#: Rows of a batch that is handed on.
ROWS = 10_000


def pieces(batches: Iterator[pa.RecordBatch], together: int | None = None) -> Iterator[list[tuple]]:
    """Rows of one key after the other, the key first; rows of a key that agree in column ``together`` are in one piece."""
    left: list[tuple] = []
    for batch in batches:
        rows = left + list(zip(*[c.to_pylist() for c in batch.columns]))
        end = len(rows)
        if together is not None:
            while end and (rows[end - 1][0], rows[end - 1][together]) == (rows[-1][0], rows[-1][together]):
                end -= 1
        left, begin = rows[end:], 0
        for i in range(1, end + 1):
            if i == end or rows[i][0] != rows[begin][0]:
                yield rows[begin:i]
                begin = i
    if left:
        yield left


def folded(rows: DataFrame, order: list[Column], step: Callable, shown: str, together: int | None = None) -> DataFrame:
    """``step(state, key, rows)`` over each key's rows in ``order``: the next state, and rows as ``shown`` says.

    rows: the first column is the key, null counts as one. The state is None
    before a key's first rows. ``together`` is the place of a column whose
    equal rows a step must see at once.
    """
    key = rows.columns[0]
    schema = pa.schema([(name, TYPES[kind]) for name, kind in (c.split(" ") for c in shown.split(", "))])

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches):
        out, state, own, begun = [], None, None, False
        for part in pieces(batches, together):
            if not begun or part[0][0] != own:
                state, own, begun = None, part[0][0], True
            state, found = step(state, str(own), part)
            out += found
            if len(out) >= ROWS:
                yield told(out)
                out = []
        if out:
            yield told(out)

    # by a hash of the key: where a join has dealt rows by the key itself Spark would leave this out, and join its small partitions
    return spread(rows, F.xxhash64(key)).sortWithinPartitions(key, *order).mapInArrow(run, shown)
