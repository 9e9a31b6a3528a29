"""User functions over examples."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The functions travel to the tasks by value: executors need pandas and pyarrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A user function gets about so many bytes of an Arrow batch at a time (a longer row stays whole).
PART_BYTES = 4 << 20


def _parts(batch: pd.DataFrame, part_bytes: int) -> Iterator[pd.DataFrame]:
    """The rows of a batch in frames of about ``part_bytes``, each numbered from 0; an empty batch as it is."""
    size = int(batch.memory_usage(index=False, deep=True).sum())
    rows = max(1, len(batch) * part_bytes // max(size, 1))
    if rows >= len(batch):
        yield batch
        return
    for start in range(0, len(batch), rows):
        yield batch.iloc[start:start + rows].reset_index(drop=True)


def map_examples(df: DataFrame, fn: Callable, schema: StructType | str | None = None,
                 remove_columns: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Apply a user function to all rows and drop the columns it replaces.

    Without ``schema``, ``fn`` maps a DataFrame to a DataFrame (Column code, optimised as
    a whole). With one, it maps a pandas batch to a pandas batch of that schema; a batch is an
    Arrow batch or a part of one, so that what it returns is never large at once.
    ``num_partitions`` sets the parallelism and costs a shuffle; leave it out to
    keep that of the input.
    """
    if num_partitions is not None:
        df = df.repartition(num_partitions)
    if schema is None:
        return df.transform(fn).drop(*remove_columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch, PART_BYTES):
                yield fn(part)
            # A batch goes before the next one is read, and its memory back to the system. Accessors such as
            # ``.str`` leave frames in reference cycles, which pile up with the rows unless they are collected.
            batch = part = None
            gc.collect()
            pa.default_memory_pool().release_unused()

    return df.mapInPandas(run, schema).drop(*remove_columns)


def filter_batches(df: DataFrame, predicate: Callable[..., Sequence[bool]],
                   columns: Sequence[str]) -> DataFrame:
    """Keep the rows for which a predicate over batches answers true.

    ``predicate`` gets one pandas Series per column and returns as many booleans. The
    batch size is the session's ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    def test(*series: pd.Series) -> pd.Series:
        gc.collect()  # what the batch before left in reference cycles, see map_examples
        answer = list(predicate(*series))
        if len(answer) != len(series[0]):
            raise ValueError("the predicate must return one answer per row")
        return pd.Series(answer, dtype=bool)

    keep = F.pandas_udf(test, "boolean")
    return df.where(keep(*columns))
