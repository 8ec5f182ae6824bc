"""Groups walked one at a time: a document's or a set's rows come together, in order, and a function of them gives the group's result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def walked(rows: DataFrame, key: str, each: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """each(a group's rows) -> (...): rows of the key and these. One shuffle by key, however far a group's rows depend on one another; a task holds one group at a time."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], names=kinds.names)

        now, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row[key] != now:
                    out += [(now, *x) for x in each(held)]
                    held = []
                now = row[key]
                held.append(row)
            if len(out) >= 10_000:
                yield made(out)
                out = []
        if held:
            out += [(now, *x) for x in each(held)]
        yield made(out)

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
