"""Scaling to new dimensions: nearest, bilinear, Lanczos, Fourier and Haar wavelet."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, Unsupported
from ..functions import kernels
from ..functions.pieces import dealt
from ..functions.policies import merge_entries
from . import tiles
from .matrix import SparseMatrix
from .validate import is_binary


def _spread(m: SparseMatrix, n_rows: int, n_cols: int) -> float:
    """Entries of the result for each row of the sources, about."""
    return max(m.spread, m.spread * (n_rows / m.n_rows) * (n_cols / m.n_cols))


def scale_nearest(m: SparseMatrix, n_rows: int, n_cols: int, policy: str = "sum", precision: str = "f64") -> SparseMatrix:
    """Every entry fills its block with its full value. Blocks of different cells are disjoint, so cells are merged first: the
    shuffle moves source entries, and the blow-up that follows is a narrow step."""
    df = m.without_zeros().merged(policy).df
    df = kernels.nearest(df, "row", m.n_rows, n_rows, "r", precision)
    df = kernels.nearest(df, "col", m.n_cols, n_cols, "c", precision)
    apart = precision == "f64" and max(m.n_rows, m.n_cols) < 1 << 50  # halves of larger indices are rounded, and so are all in single precision
    return SparseMatrix(df.select(F.col("r").alias("row"), F.col("c").alias("col"), "value"), n_rows, n_cols, apart, _spread(m, n_rows, n_cols))


#: A weight counts above this. Up to its inverse many cells no product of two true weights comes near it, so it cuts rounding noise only.
LEAST_WEIGHT = 1e-12


def scale_bilinear(m: SparseMatrix, n_rows: int, n_cols: int, precision: str = "f64") -> SparseMatrix:
    """Sums of weighted neighbours whose weight, the product of both axes', is above LEAST_WEIGHT. They are summed tile by tile, with the cut on
    each axis; only merged cells are shuffled. Where true weights can come near the cut (single precision, or very many cells) both axes are
    spread before the product is cut."""
    df, grown = m.without_zeros().merged().df, _spread(m, n_rows, n_cols)
    if precision == "f64" and n_rows * n_cols <= 1 / LEAST_WEIGHT:
        df = tiles.scaled(df, tiles.Axis("bilinear", m.n_rows, n_rows), tiles.Axis("bilinear", m.n_cols, n_cols), m.spread, LEAST_WEIGHT)
        return SparseMatrix(df, n_rows, n_cols, True, grown)
    df = kernels.bilinear(df, "row", m.n_rows, n_rows, "r", "wr", precision)
    df = kernels.bilinear(df, "col", m.n_cols, n_cols, "c", "wc", precision).filter(F.col("wr") * F.col("wc") > LEAST_WEIGHT)
    df = dealt(df.select(F.col("r").alias("row"), F.col("c").alias("col"), (F.col("value") * F.col("wr") * F.col("wc")).alias("value")), "row", "col", spread=4 * grown)
    return SparseMatrix(df.groupBy("row", "col").agg(F.sum("value").alias("value")), n_rows, n_cols, True, grown)


def lanczos_candidates(m: SparseMatrix, size: int) -> DataFrame:
    """Cells around the scaled place of every stored entry, explicit zeros included; a cell may come more than once."""
    s = size / m.n_rows
    rho = kernels.lanczos_radius(s)
    near = lambda c: F.least(F.floor(F.col(c) * F.lit(s) + 0.5), F.lit(size - 1))
    places = m.df.select(near("row").alias("r"), near("col").alias("c")).distinct()
    around = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - rho, F.lit(0)), F.least(F.col(c) + rho, F.lit(size - 1))))
    return places.select(around("r").alias("row"), "c").select("row", around("c").alias("col"))


def _first_rows(m: SparseMatrix, size: int, cap: int) -> SparseMatrix:
    """The rows of merged cells that the first ``cap`` candidates come from and sample. Every place is a candidate itself, so as many places in
    order give as many candidates no later than the last of these places."""
    s, rho = size / m.n_rows, kernels.lanczos_radius(size / m.n_rows)
    shared = 1 if s >= 1 else (math.ceil(1 / s) + 1) ** 2  # cells of one place, at most
    first = m.df.select("row", "col").orderBy("row", "col").limit(cap * shared)
    last = first.agg(F.least(F.floor(F.max("row") * F.lit(s) + 0.5), F.lit(size - 1)).alias("last"))
    upto = last.select((F.ceil((F.col("last") + rho + 1) / F.lit(s)) + 3).alias("upto"))
    return m.with_df(m.df.crossJoin(F.broadcast(upto)).filter("row <= upto").drop("upto"), True)  # one row


def _scale_candidates(m: SparseMatrix, size: int, candidates: DataFrame) -> DataFrame:
    """Results on the given candidates: the row axis is spread and summed; then stretches of a row's candidates meet the sums that reach into them."""
    width = max(16, math.ceil(6 * size / m.n_cols))  # columns of a stretch; it has no more candidates than that
    stretches = candidates.groupBy(F.col("row").alias("r"), F.expr(f"col div {width}").alias("stretch")).agg(F.collect_set("col").alias("cs"))
    df = kernels.lanczos(m.df.filter("value <> 0"), "row", m.n_rows, size, "r", "wr", "tr")
    df = df.groupBy("r", "col").agg(F.sum(F.col("value") * F.col("wr") / F.col("tr")).alias("value"))
    low, high = kernels.lanczos_reach("col", m.n_cols, size)
    df = df.withColumn("lo", low).withColumn("hi", high).filter("hi > lo").withColumn("stretch", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    df = df.join(stretches, ["r", "stretch"]).select("r", "col", "value", F.explode("cs").alias("c"))
    df = kernels.lanczos_weights(df, "col", m.n_cols, size, "c", "wc", "tc")
    return df.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum(F.col("value") * F.col("wc") / F.col("tc")).alias("value"))


def scale_lanczos(m: SparseMatrix, n_rows: int, n_cols: int, candidate_cap: int | None = None) -> SparseMatrix:
    """Normalised three-lobed kernel on the candidates, tile by tile.

    ``candidate_cap`` keeps the first candidates by row and column; there is none unless it is asked for. Then only the rows that these
    candidates come from and sample are scaled.
    """
    if m.n_rows != m.n_cols or n_rows != n_cols:
        raise InvalidArgument("Lanczos scaling goes from square to square")
    cells = m.merged()
    if candidate_cap is None:
        axis = tiles.Axis("lanczos", m.n_rows, n_rows)
        return SparseMatrix(tiles.scaled(cells.df, axis, axis, m.spread), n_rows, n_cols, True, _spread(m, n_rows, n_cols))
    cells = _first_rows(cells, n_rows, candidate_cap)
    candidates = lanczos_candidates(cells, n_rows).distinct().orderBy("row", "col").limit(candidate_cap)
    df = _scale_candidates(cells, n_rows, candidates)
    return SparseMatrix(df.filter(F.abs("value") > 1e-10), n_rows, n_cols, True, _spread(m, n_rows, n_cols))


def scale_fft(m: SparseMatrix, n_rows: int, n_cols: int, threshold: float | None = None, batch_rows: int | None = 256) -> SparseMatrix:
    """Fourier interpolation along each row, then down the columns within batches of rows; small results are dropped.

    The threshold is 0.7 for binary matrices and 0.1 for others unless it is given. Of entries of one cell the last counts, or their sum
    where they have no order. Kernels of a size that may be broadcast
    are joined; beyond that, each batch of rows is transformed by one grouped call that holds batch_rows dense rows.
    """
    if threshold is None:
        threshold = 0.7 if is_binary(m) else 0.1
    if not 0 <= threshold <= 1:
        raise InvalidArgument("the threshold lies between 0 and 1")
    if n_cols < m.n_cols // 2 or n_rows < m.n_rows // 2:
        raise Unsupported("Fourier scaling below half the size has no defined result")
    batches = kernels.fourier_batches(m.n_rows, n_rows, batch_rows)
    df = m.merged("last" if "seq" in m.df.columns else "sum").df
    if m.n_cols * n_cols <= kernels.BROADCAST_ROWS:
        k_col = kernels.kernel_relation(m.spark, [(0, m.n_cols, 0, n_cols)])
        df = df.join(kernels.sized(k_col, m.n_cols * n_cols), F.col("col") == F.col("src"))
        df = df.groupBy("row", F.col("dst").alias("c")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
        size = sum(b[1] * b[3] for b in batches)
        k_row = kernels.kernel_relation(m.spark, batches)
        df = df.join(kernels.sized(k_row, size), F.col("row") == F.col("src"))
        df = df.select(F.col("dst").alias("r"), "c", (F.col("value") * F.col("w")).alias("value"), F.col("row"))
        df = df.groupBy(F.floor(F.col("row") / (batch_rows or m.n_rows)).alias("batch"), "r", "c").agg(F.sum("value").alias("value"))
    else:
        df = _fft_by_batch(df, m, n_rows, n_cols, batch_rows)
    df = df.filter((F.abs("value") >= threshold) & (F.abs("value") > 1e-15) & (F.col("r") < n_rows))
    df = df.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum("value").alias("value"))
    return SparseMatrix(df, n_rows, n_cols)


def _fft_by_batch(df: DataFrame, m: SparseMatrix, n_rows: int, n_cols: int, batch_rows: int | None) -> DataFrame:
    step, cols = batch_rows or m.n_rows, m.n_cols
    by_first = {b[0]: b for b in kernels.fourier_batches(m.n_rows, n_rows, batch_rows)}

    def resize(x: np.ndarray, n_dst: int) -> np.ndarray:
        n_src = x.shape[1]
        spectrum, padded = np.fft.fft(x, axis=1), np.zeros((x.shape[0], n_dst), complex)
        low, high = (n_src + 1) // 2, n_src // 2
        padded[:, : min(low, n_dst)] = spectrum[:, : min(low, n_dst)]
        if high:
            padded[:, n_dst - high :] = spectrum[:, n_src - high :]
        return np.fft.ifft(padded, axis=1).real * (n_dst / n_src)

    def work(key, pdf):
        import pandas as pd

        first, n, start, out_rows = by_first[int(key[0]) * step]
        dense = np.zeros((n, cols))
        dense[pdf["row"].to_numpy() - first, pdf["col"].to_numpy()] = pdf["value"].to_numpy()
        wide = resize(resize(dense, n_cols).T, out_rows).T
        r, c = np.nonzero(np.abs(wide) > 1e-15)
        return pd.DataFrame({"batch": int(key[0]), "r": r + start, "c": c, "value": wide[r, c]})

    return df.groupBy(F.floor(F.col("row") / step).alias("batch")).applyInPandas(work, "batch long, r long, c long, value double")


def scale_wavelet(m: SparseMatrix, n_rows: int, n_cols: int, policy: str = "sum", allow_anisotropic: bool = False) -> SparseMatrix:
    """Two-level Haar tiles of 4 x 4, as a join with the impulse responses of a tile's 16 cells (at most 25 600 rows). Of entries of one cell
    the last counts, or their sum where they have no order."""
    s = float(np.float32(n_rows) / np.float32(m.n_rows))
    if not allow_anisotropic and n_cols * m.n_rows != n_rows * m.n_cols:
        raise InvalidArgument("wavelet scaling uses the row ratio for both axes; allow_anisotropic=True accepts another column ratio")
    size = kernels.wavelet_size(s)
    impulses = m.spark.createDataFrame(kernels.wavelet_impulses(s), "tr int, tc int, i int, j int, w double")
    df = m.merged("last" if "seq" in m.df.columns else "sum").df
    df = df.withColumn("tr", (F.col("row") % 4).cast("int")).withColumn("tc", (F.col("col") % 4).cast("int"))
    df = df.withColumn("br", F.expr("row div 4")).withColumn("bc", F.expr("col div 4"))
    df = dealt(df, "br", "bc", spread=_spread(m, n_rows, n_cols)).join(F.broadcast(impulses), ["tr", "tc"]).groupBy("br", "bc", "i", "j").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    origin = lambda b: F.floor((4 * F.col(b) * F.lit(s)).cast("float")).cast("long")
    df = df.filter(F.abs("value") > 1e-5).select((origin("br") + F.col("i")).alias("row"), (origin("bc") + F.col("j")).alias("col"), "value", (F.col("br") * (1 << 31) + F.col("bc")).alias("seq"))
    df = df.filter((F.col("row") < n_rows) & (F.col("col") < n_cols))
    overlap = size > 4 * s
    return SparseMatrix(merge_entries(df, policy) if overlap else df.drop("seq"), n_rows, n_cols)


METHODS: dict[str, Callable[..., SparseMatrix]] = {"nearest": scale_nearest, "bilinear": scale_bilinear, "lanczos": scale_lanczos, "fft": scale_fft, "wavelet": scale_wavelet}


def register_method(name: str, method: Callable[..., SparseMatrix]) -> None:
    """Add a scaling method: called with the matrix, the new dimensions and options."""
    METHODS[name] = method


def scale(m: SparseMatrix, method: str, n_rows: int, n_cols: int, **options: object) -> SparseMatrix:
    if method not in METHODS:
        raise InvalidArgument(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    if n_rows <= 0 or n_cols <= 0:
        raise InvalidArgument("dimensions must be positive")
    return METHODS[method](m, n_rows, n_cols, **options)
