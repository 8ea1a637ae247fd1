"""Folds in time order over the rows of a key, streamed: a task holds one batch and one state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Any, step: Callable[[Any, dict], tuple[Any, dict | None]], out: str) -> DataFrame:
    """Rows that `step` gives for each key's rows in order: (state, row) to (state, columns of `out` besides the keys, or None).

    A key's rows are sorted in one partition and read once, however many there are; nothing of a key is gathered."""
    schema = StructType([f for f in rows.schema.fields if f.name in keys] + StructType.fromDDL(out).fields)
    arrow, names = to_arrow_schema(schema), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start
        for b in batches:
            made: dict[str, list] = {n: [] for n in names}
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != last:
                    last, state = key, start
                state, got = step(state, row)
                if got is not None:
                    for n in names:
                        made[n].append(row[n] if n in keys else got[n])
            yield pa.RecordBatch.from_pydict(made, schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
