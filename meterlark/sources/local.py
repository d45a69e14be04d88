"""Small tables made on the driver, and whether a table is known to be small."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes up to which a side may be broadcast by hand.
BROADCAST_BYTES = 64 << 20


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation: its size is known to the optimiser, and no job makes it."""
    fields = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow), schema=fields)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's own estimate; of unknown sizes a very large one.  Runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the optimiser's own estimate is within the limit; unknown sizes are large.  Runs no job."""
    return estimated_bytes(df) <= limit
