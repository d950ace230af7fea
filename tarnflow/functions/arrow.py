"""Functions over Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches that long values can't make larger than memory.

    The bound is a setting that Spark reads when the query runs, so it stays set in the session.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df.mapInArrow(function, schema)


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows ordered by their first ``keys`` columns -> each key with its rows, which must fit in memory."""
    place, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [False] * batch.num_rows
        for column in batch.columns[:keys]:
            values = column.to_pylist()
            new = [n or a != b for n, a, b in zip(new, values, [values[0], *values], strict=False)]
        cuts = [0, *[i for i, n in enumerate(new) if n], batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(c[a].as_py() for c in batch.columns[:keys])
            if held and own != place:
                yield place, pa.Table.from_batches(held)
                held = []
            place = own
            held.append(batch.slice(a, b - a))
    if held:
        yield place, pa.Table.from_batches(held)
