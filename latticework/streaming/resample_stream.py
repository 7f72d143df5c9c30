"""An extension: entries that arrive as a stream are resampled and summed in update mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import kernels


def resample_stream(entries: DataFrame, method: str, n_src: tuple[int, int], n_dst: tuple[int, int]) -> DataFrame:
    """Running sums of the scaled cells of a streaming DataFrame (row, col, value); spreading is stateless, the sum is the state."""
    df = entries.filter("value <> 0")
    if method == "nearest":
        df = kernels.nearest(kernels.nearest(df, "row", n_src[0], n_dst[0], "r"), "col", n_src[1], n_dst[1], "c")
        value = F.col("value")
    elif method == "bilinear":
        df = kernels.bilinear(kernels.bilinear(df, "row", n_src[0], n_dst[0], "r", "wr"), "col", n_src[1], n_dst[1], "c", "wc")
        value = F.col("value") * F.col("wr") * F.col("wc")
    else:
        raise InvalidArgument("streams are scaled by nearest or bilinear")
    return df.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum(value).alias("value"))
