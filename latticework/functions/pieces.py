"""How many tasks a shuffle is dealt to: by the size of what its rows are made from, so that what one task holds stays the same on larger inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

#: Bytes of source files whose rows one task holds: some 600 000 entries of lineitem.
PIECE_BYTES = 8 << 20
#: Sizes from here on are Spark's word for "unknown".
UNKNOWN = 1 << 60


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files that the frame reads, each time it reads them; rows that come from elsewhere count as none."""
    if df.isStreaming:
        return 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN)


def dealt(df: DataFrame, *keys: str | Column, spread: float = 1.0) -> DataFrame:
    """The frame dealt out by its keys to a task for each PIECE_BYTES of its sources, times ``spread``, the rows it has for a source row. An
    aggregation by these keys needs no other shuffle. Small frames are returned as they are: Spark's own shuffle has tasks enough for them."""
    n = -int(-source_bytes(df) * spread // PIECE_BYTES)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df
