"""Names of helper columns, batches and lists of Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that go to a Python worker at once, unless the session sets its own number: texts can be long.
ARROW_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # the default
        spark.conf.set(key, ARROW_ROWS)


def list_array(rows: list[np.ndarray | None], values: Callable[[np.ndarray], pa.Array], kind: type, width: int = 0) -> pa.Array:
    """An array of lists from one array a row, null for None; values makes the elements of all rows put together. width: columns, 0 for none."""
    sizes = [0 if r is None else len(r) for r in rows]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    missing = pa.array([r is None for r in rows], pa.bool_())
    whole = np.concatenate([np.empty((0, width) if width else 0, kind), *(r for r in rows if r is not None)])
    return pa.ListArray.from_arrays(offsets, values(whole), mask=missing)


def unused(name: str, *frames: DataFrame) -> str:
    """The name, lengthened until no column of frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
