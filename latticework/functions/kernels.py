"""Axis kernels as column expressions: from a source index to the destination indices it reaches, with weights.

Scattering by expression keeps resampling free of joins: an interval is exploded and its weights are computed in
generated code. ``precision="f32"`` rounds every step to single precision, as the strict mode of results asks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument, Unsupported


def _rounded(c: Column, precision: str) -> Column:
    return c.cast("float").cast("double") if precision == "f32" else c


def _scale(n_src: int, n_dst: int, precision: str) -> float:
    if n_src <= 0 or n_dst <= 0:
        raise InvalidArgument("dimensions must be positive")
    if precision not in ("f32", "f64"):
        raise InvalidArgument(f"unknown precision {precision!r}")
    return float(np.float32(n_dst) / np.float32(n_src)) if precision == "f32" else n_dst / n_src


def _explode(df: DataFrame, lo: Column, hi: Column, out: str) -> DataFrame:
    """A row for each index in [lo, hi); empty intervals are dropped before sequence() could count down."""
    return df.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long")).filter("_hi > _lo").withColumn(out, F.explode(F.sequence("_lo", F.col("_hi") - 1))).drop("_lo", "_hi")


def nearest(df: DataFrame, axis: str, n_src: int, n_dst: int, out: str, precision: str = "f64") -> DataFrame:
    """Half-open block ceil((i - 1/2) s) to floor((i + 1/2) s) around each scaled index; the low end is held at 0."""
    s = F.lit(_scale(n_src, n_dst, precision))
    i = _rounded(F.col(axis).cast("double"), precision)
    lo = F.ceil(_rounded(_rounded(i - 0.5, precision) * s, precision))
    hi = F.floor(_rounded(_rounded(i + 0.5, precision) * s, precision))
    return _explode(df, F.greatest(F.lit(0), F.least(lo, F.lit(n_dst))), F.greatest(F.lit(0), F.least(hi, F.lit(n_dst))), out)


def bilinear(df: DataFrame, axis: str, n_src: int, n_dst: int, out: str, weight: str, precision: str = "f64") -> DataFrame:
    """Destinations whose two source neighbours include the index; a neighbour clamped onto the other adds nothing."""
    s = F.lit(_scale(n_src, n_dst, precision))
    i = _rounded(F.col(axis).cast("double"), precision)
    lo = F.ceil(_rounded(F.greatest(F.lit(0.0), (i - 1) * s), precision))
    hi = F.ceil(_rounded((i + 1) * s, precision))
    df = _explode(df, F.greatest(F.lit(0), F.least(lo, F.lit(n_dst))), F.least(hi, F.lit(n_dst)), out)
    y = _rounded(F.col(out).cast("double") / s, precision)
    y0 = F.least(F.floor(y), F.lit(n_src - 1))
    y1 = F.least(F.ceil(y), F.lit(n_src - 1))
    f = F.greatest(F.lit(0.0), F.least(_rounded(y - y0.cast("double"), precision), F.lit(1.0)))
    w = F.when(F.col(axis) == y0, _rounded(1 - f, precision)).when(F.col(axis) == y1, f).otherwise(0.0)
    return df.withColumn(weight, w).filter(F.col(weight) > 0)


def lanczos_weight(x: Column) -> Column:
    """The windowed sinc with three lobes."""
    px = x * math.pi
    return F.when(x == 0, 1.0).when(F.abs(x) >= 3, 0.0).otherwise(3 * F.sin(px) * F.sin(px / 3) / (px * px))


def lanczos_weights_of(x: np.ndarray) -> np.ndarray:
    """The same for an array."""
    px = x * math.pi
    with np.errstate(invalid="ignore", divide="ignore"):
        w = 3 * np.sin(px) * np.sin(px / 3) / (px * px)
    return np.where(x == 0, 1.0, np.where(np.abs(x) >= 3, 0.0, w))


def lanczos_reach(axis: str, n_src: int, n_dst: int) -> tuple[Column, Column]:
    """[low, high) of destinations among which are all that sample the index."""
    s, i = F.lit(_scale(n_src, n_dst, "f64")), F.col(axis).cast("double")
    return F.greatest(F.lit(0), F.floor((i - 4) * s)), F.least(F.ceil((i + 4) * s) + 1, F.lit(n_dst))


def lanczos_weights(df: DataFrame, axis: str, n_src: int, n_dst: int, out: str, weight: str, total: str) -> DataFrame:
    """Of rows with a source index and a destination: those where the index is one of the six samples, its weight, and the weight of all samples in bounds."""
    y = F.col(out).cast("double") / F.lit(_scale(n_src, n_dst, "f64"))
    base, frac = F.floor(y), y - F.floor(y)
    offset = F.col(axis) - base
    df = df.filter((offset >= -2) & (offset <= 3)).withColumn(weight, lanczos_weight(frac - offset.cast("double")))
    parts = [F.when((base + o >= 0) & (base + o < n_src), lanczos_weight(frac - float(o))).otherwise(0.0) for o in range(-2, 4)]
    return df.withColumn(total, sum(parts[1:], parts[0]))


def lanczos(df: DataFrame, axis: str, n_src: int, n_dst: int, out: str, weight: str, total: str) -> DataFrame:
    """A row for each destination that samples the index, with weights."""
    low, high = lanczos_reach(axis, n_src, n_dst)
    return lanczos_weights(_explode(df, low, high, out), axis, n_src, n_dst, out, weight, total)


def lanczos_radius(scale: float) -> int:
    """How far candidates reach around a scaled index."""
    return 0 if scale <= 1 else max(2, min(6, math.ceil(math.sqrt(scale))))


def fourier_matrix(n_src: int, n_dst: int) -> np.ndarray:
    """Destination by source: spectrum of n_src points cut or padded to n_dst, low frequencies first, then back."""
    if n_dst < n_src // 2:
        raise Unsupported("Fourier scaling below half the size has no defined result")
    spectrum = np.fft.fft(np.eye(n_src), axis=0)
    padded = np.zeros((n_dst, n_src), complex)
    low, high = (n_src + 1) // 2, n_src // 2
    padded[: min(low, n_dst)] = spectrum[: min(low, n_dst)]
    if high:
        padded[n_dst - high :] = spectrum[n_src - high :]
    return np.fft.ifft(padded, axis=0).real * (n_dst / n_src)


def fourier_batches(n_rows: int, out_rows: int, batch_rows: int | None) -> list[tuple[int, int, int, int]]:
    """(first row, rows, first output row, output rows) of each batch of source rows."""
    step, scale = batch_rows or n_rows, np.float32(out_rows) / np.float32(n_rows)
    out = []
    for a in range(0, n_rows, step):
        b = min(a + step, n_rows)
        start = int(np.float32(a) * scale)
        out.append((a, b - a, start, max(int(np.float32(b) * scale) - start, 1)))
    return out


KERNEL = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("w", T.DoubleType())])
#: A kernel relation of 24-byte rows is broadcast up to this many rows (48 MB), else it is joined by shuffle.
BROADCAST_ROWS = 2_000_000


def kernel_relation(spark: SparkSession, blocks: list[tuple[int, int, int, int]]) -> DataFrame:
    """K(src, dst, w) of Fourier blocks; every row of a block's matrix is made by a task, not by the driver."""
    rows = spark.createDataFrame([(*b, j) for b in blocks for j in range(b[3])], "a long, n long, start long, m long, j long") if sum(b[3] for b in blocks) <= 10_000 else None
    if rows is None:
        table = spark.createDataFrame(blocks, "a long, n long, start long, m long")
        rows = table.withColumn("j", F.explode(F.expr("sequence(0, m - 1)")))

    def make(batches):
        import pandas as pd

        known: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            parts = []
            for a, n, start, m, j in pdf.itertuples(index=False):
                if (n, m) not in known:
                    known.clear()
                    known[n, m] = fourier_matrix(n, m)
                parts.append(pd.DataFrame({"src": np.arange(a, a + n), "dst": start + j, "w": known[n, m][j]}))
            if parts:
                yield pd.concat(parts)

    return rows.mapInPandas(make, KERNEL)


def sized(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast a relation whose number of rows is known and small."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def haar_forward(tile: np.ndarray) -> np.ndarray:
    """Two levels over a 4 x 4 tile (last axes): halves of sums and differences, the second level on the top-left quarter."""
    out = tile.astype(float).copy()
    for n in (4, 2):
        for axis in (-1, -2):
            part = np.moveaxis(out[..., :n, :n], axis, -1)
            half = np.concatenate([(part[..., ::2] + part[..., 1::2]) / 2, (part[..., ::2] - part[..., 1::2]) / 2], -1)
            out[..., :n, :n] = np.moveaxis(half, -1, axis)
    return out


def haar_inverse(coefficients: np.ndarray) -> np.ndarray:
    out = coefficients.copy()
    size = out.shape[-1]
    for n in (size // 2, size):
        for axis in (-2, -1):
            part = np.moveaxis(out[..., :n, :n], axis, -1)
            mean, gap = part[..., : n // 2], part[..., n // 2 :]
            whole = np.stack([mean + gap, mean - gap], -1).reshape(*part.shape)
            out[..., :n, :n] = np.moveaxis(whole, -1, axis)
    return out


def wavelet_size(scale: float) -> int:
    if scale > 10:
        raise Unsupported("wavelet scaling is defined up to a factor of 10")
    size = int(4 * np.float32(scale))
    size += size % 2
    if size < 4 or size % 4:
        raise Unsupported("wavelet scaling needs a tile size that is a multiple of 4")
    return size


def wavelet_impulses(scale: float) -> list[tuple[int, int, int, int, float]]:
    """(row in tile, column in tile, output row, output column, weight): what each cell of a 4 x 4 tile contributes."""
    size = wavelet_size(scale)
    nearest_index = np.clip(np.floor(np.arange(size, dtype=np.float32) / np.float32(scale)), 0, 3).astype(int)
    tiles = np.eye(16).reshape(16, 4, 4)
    out = haar_inverse(haar_forward(tiles)[:, nearest_index][:, :, nearest_index])
    return [(k // 4, k % 4, int(i), int(j), float(out[k, i, j])) for k in range(16) for i, j in zip(*np.nonzero(out[k]), strict=True)]
