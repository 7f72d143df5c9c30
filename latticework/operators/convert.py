"""Between entries and the row-compressed layout, and what row counts tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from .matrix import SparseMatrix

#: Rows of the matrix that share one window when offsets are summed.
PIECE = 1 << 16


def row_counts(m: SparseMatrix, axis: str = "row", empty: bool = False) -> DataFrame:
    """(axis, nnz) of the rows or columns with entries; with ``empty`` of all."""
    counts = m.df.groupBy(axis).agg(F.count(F.lit(1)).alias("nnz"))
    if not empty:
        return counts
    every = m.spark.range(m.n_rows if axis == "row" else m.n_cols).withColumnRenamed("id", axis)
    return every.join(counts, axis, "left").select(axis, F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))


def row_ptr(m: SparseMatrix) -> DataFrame:
    """(row, start, end) of all rows. Offsets are summed within pieces of PIECE rows, then over the pieces, so no window holds all rows."""
    counts = row_counts(m, empty=True).withColumn("piece", F.expr(f"row div {PIECE}"))
    sums = counts.groupBy("piece").agg(F.sum("nnz").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("piece", before.alias("before"))
    inside = F.sum("nnz").over(Window.partitionBy("piece").orderBy("row"))
    out = counts.withColumn("inside", inside).join(sums, "piece")
    return out.select("row", (F.col("before") + F.col("inside") - F.col("nnz")).alias("start"), (F.col("before") + F.col("inside")).alias("end"))


def row_range(m: SparseMatrix, row: int) -> tuple[int, int]:
    """Offsets of one row: the entries in the rows before, and those plus its own."""
    m._check(row)
    r = m.df.filter(F.col("row") <= row).agg(F.count_if(F.col("row") < row).alias("a"), F.count(F.lit(1)).alias("b")).first()
    return int(r["a"]), int(r["b"])


def row_stats(m: SparseMatrix) -> DataFrame:
    """One row: least, greatest and mean entries of a row, empty rows included."""
    s = m.df.groupBy("row").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"))
    least = F.when(F.col("rows") < m.n_rows, F.lit(0)).otherwise(F.col("least"))
    return s.select(F.coalesce(least, F.lit(0)).cast("long").alias("min_nnz"), F.coalesce("most", F.lit(0)).cast("long").alias("max_nnz"), (F.coalesce("total", F.lit(0)) / F.lit(float(m.n_rows))).alias("avg_nnz"))


def to_csr(m: SparseMatrix, dedup: str | None = None) -> DataFrame:
    """(row, cols, vals) of rows with entries, columns ascending. Duplicate cells raise unless ``dedup`` names a policy."""
    if dedup:
        m = m.merged(dedup)
    elif not m.unique and m.dealt("row", "col").groupBy("row", "col").count().filter("count > 1").take(1):
        raise InvalidArgument("duplicate cells: the row-compressed layout holds one entry a cell; name a policy in dedup")
    rows = m.dealt("row").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("e"))
    return rows.select("row", F.col("e")["col"].alias("cols"), F.col("e")["value"].alias("vals"))


def from_csr(rows: DataFrame, n_rows: int, n_cols: int) -> SparseMatrix:
    df = rows.select("row", F.inline(F.arrays_zip(F.col("cols").alias("col"), F.col("vals").alias("value"))))
    return SparseMatrix(df.toDF("row", "col", "value"), n_rows, n_cols)


def row_ranks(m: SparseMatrix) -> DataFrame:
    """Entries with their place inside the row."""
    return m.dealt("row").withColumn("rank", (F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1).cast("long"))


def row_owners(m: SparseMatrix, parts: int) -> DataFrame:
    """(part, first_row, rows, nnz): contiguous row blocks, the first ``n_rows % parts`` one row longer."""
    base, extra = divmod(m.n_rows, parts)
    split = extra * (base + 1)
    owner = F.when(F.col("row") < split, F.expr(f"row div {base + 1}")).otherwise(F.lit(extra) + F.floor((F.col("row") - split) / max(base, 1)))
    counts = m.df.groupBy(owner.cast("long").alias("part")).agg(F.count(F.lit(1)).alias("nnz"))
    every = m.spark.range(parts).withColumnRenamed("id", "part")
    first = F.col("part") * base + F.least(F.col("part"), F.lit(extra))
    return every.join(counts, "part", "left").select("part", first.alias("first_row"), (F.lit(base) + F.when(F.col("part") < extra, 1).otherwise(0)).cast("long").alias("rows"), F.coalesce("nnz", F.lit(0)).alias("nnz"))
