"""Invariants as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policies import FEW_CELLS
from .matrix import SparseMatrix


def _outside(m: SparseMatrix):
    return F.col("row").isNull() | F.col("col").isNull() | (F.col("row") < 0) | (F.col("row") >= m.n_rows) | (F.col("col") < 0) | (F.col("col") >= m.n_cols)


def coo_violations(m: SparseMatrix) -> DataFrame:
    """One row: nnz, out_of_bounds, bad_values (null, NaN or infinite), valid."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    counts = m.df.agg(F.count(F.lit(1)).alias("nnz"), F.count_if(_outside(m)).alias("out_of_bounds"), F.count_if(bad).alias("bad_values"))
    return counts.withColumn("valid", F.col("out_of_bounds") == 0)


def csr_violations(m: SparseMatrix) -> DataFrame:
    """One row: nnz, out_of_bounds, duplicate_cells, valid. The row-compressed layout allows one entry a cell."""
    few = m.n_rows * m.n_cols <= FEW_CELLS
    cells = (m.df if few else m.dealt("row", "col")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    counts = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"), F.coalesce(F.sum(F.when(_outside(m), F.col("n"))), F.lit(0)).alias("out_of_bounds"), F.count_if(F.col("n") > 1).alias("duplicate_cells"))
    return counts.withColumn("valid", (F.col("out_of_bounds") == 0) & (F.col("duplicate_cells") == 0))


def binary_sample(m: SparseMatrix, sample: int = 10_000) -> DataFrame:
    """One row: whether the first ``sample`` stored values by row and column are all 1 within 1e-9."""
    first = m.df.orderBy("row", "col").limit(sample)
    return first.agg(F.coalesce(F.bool_and(F.abs(F.col("value") - 1) <= 1e-9), F.lit(True)).alias("is_binary"))


def is_binary(m: SparseMatrix, sample: int = 10_000) -> bool:
    return bool(binary_sample(m, sample).first()[0])
