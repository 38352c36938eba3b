"""Sequential models over ordered rows: one model for each group, streamed over its sorted rows.

A model's state is a few numbers, so a group may be of any size. What a window or an aggregate can say should be one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def fold(rows: DataFrame, by: list[str], order: str, make: Callable[[], Any], step: Callable[[Any, dict], tuple], out: str) -> DataFrame:
    """The rows with the columns ``out`` (DDL): what ``step(model, row)`` returns, where ``make()`` gives each group its model."""
    added = StructType.fromDDL(out)
    names, types = rows.columns, added.fieldNames()
    dealt = rows.repartition(*by).sortWithinPartitions(*by, order)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added]
        model, now, begun = None, None, False
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                key = tuple(row[c] for c in by)
                if not begun or key != now:
                    model, now, begun = make(), key, True
                found.append(step(model, row))
            columns = list(zip(*found, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*names, *types])

    return dealt.mapInArrow(run, StructType([*dealt.schema.fields, *added.fields]))
