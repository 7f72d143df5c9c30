"""A sparse matrix: an immutable wrapper over a DataFrame of entries and its dimensions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.pieces import dealt
from ..functions.policies import merge_entries

SCHEMA = "row long, col long, value double, seq long"
#: Bytes of the coordinate and row-compressed layouts, for memory estimates: index, index, value.
INDEX_BYTES, VALUE_BYTES = 8, 4
#: Policies that leave a cell's only entry as it is.
ALONE = ("sum", "avg", "max", "min")


@dataclass(frozen=True)
class SparseMatrix:
    """``df`` has row, col (from 0), value and, where the order of entries matters, seq. All methods are lazy unless they return plain values.
    ``unique``: no cell has two entries, so nothing is left to merge. ``spread``: entries for each row of the sources, about; tasks are dealt out by it."""

    df: DataFrame
    n_rows: int
    n_cols: int
    unique: bool = False
    spread: float = 1.0

    def __post_init__(self):
        if self.n_rows <= 0 or self.n_cols <= 0:
            raise InvalidArgument("dimensions must be positive")
        if max(self.n_rows, self.n_cols) >= 1 << 63:
            raise InvalidArgument("dimensions must be below 2**63")

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @classmethod
    def empty(cls, spark: SparkSession, n_rows: int, n_cols: int) -> SparseMatrix:
        return cls(spark.createDataFrame([], SCHEMA), n_rows, n_cols)

    @classmethod
    def from_entries(cls, spark: SparkSession, entries: Iterable[tuple[int, int, float]], n_rows: int, n_cols: int) -> SparseMatrix:
        rows = [(int(r), int(c), float(v), k) for k, (r, c, v) in enumerate(entries)]
        if any(not (0 <= r < n_rows and 0 <= c < n_cols) for r, c, _, _ in rows):
            raise InvalidArgument("an entry lies outside the matrix")
        return cls(spark.createDataFrame(rows, SCHEMA), n_rows, n_cols)

    @classmethod
    def builder(cls, spark: SparkSession, n_rows: int, n_cols: int) -> MatrixBuilder:
        return MatrixBuilder(spark, n_rows, n_cols)

    def with_df(self, df: DataFrame, unique: bool = False) -> SparseMatrix:
        return SparseMatrix(df, self.n_rows, self.n_cols, unique, self.spread)

    def append(self, other: SparseMatrix) -> SparseMatrix:
        """The entries of both, duplicates and all; those of ``other`` come later. Entries without an order of their own have none among
        themselves: they come together, after or before the others as the parts do."""
        if "seq" not in self.df.columns and "seq" not in other.df.columns:
            return self.with_df(self.df.unionByName(other.df))
        mine, theirs = (m.df if "seq" in m.df.columns else m.df.withColumn("seq", F.lit(0).cast("long")) for m in (self, other))
        # One row each: how far the second part moves so that it begins after the first one's end.
        last = mine.agg(F.max("seq").alias("last")).crossJoin(F.broadcast(theirs.agg(F.min("seq").alias("first"))))
        shift = last.select((F.coalesce("last", F.lit(-1)) - F.coalesce("first", F.lit(0)) + 1).alias("lw_shift"))
        moved = theirs.crossJoin(F.broadcast(shift)).withColumn("seq", F.col("seq") + F.col("lw_shift")).drop("lw_shift")
        return self.with_df(mine.unionByName(moved))

    def clear(self) -> SparseMatrix:
        return self.with_df(self.df.limit(0))

    def merged(self, policy: str = "sum") -> SparseMatrix:
        if self.unique and policy in ALONE and dict(self.df.dtypes)["value"] == "double":
            return self.with_df(self.df.select("row", "col", "value"), True)
        return self.with_df(merge_entries(self.df, policy, cells=self.n_rows * self.n_cols, spread=self.spread), True)

    def dealt(self, *keys: str) -> DataFrame:
        """The entries dealt out by these columns, to tasks by their size."""
        return dealt(self.df, *keys, spread=self.spread)

    def sorted(self) -> SparseMatrix:
        """A global order by row and column: range partitioning and a sort inside each partition."""
        return self.with_df(self.df.orderBy("row", "col"), self.unique)

    def transposed(self) -> SparseMatrix:
        others = [c for c in self.df.columns if c not in ("row", "col")]
        return SparseMatrix(self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), *others), self.n_cols, self.n_rows, self.unique, self.spread)

    def partitioned(self, n: int | None = None) -> SparseMatrix:
        """Contiguous row ranges, one or more to a partition."""
        return self.with_df(self.df.repartitionByRange(n, "row") if n else self.df.repartitionByRange("row"))

    def without_zeros(self) -> SparseMatrix:
        return self.with_df(self.df.filter("value <> 0"), self.unique)

    def above(self, threshold: float, strict: bool = True) -> SparseMatrix:
        size = F.abs("value")
        return self.with_df(self.df.filter(size > threshold if strict else size >= threshold), self.unique)

    def _check(self, row: int, col: int = 0) -> None:
        if not (0 <= row < self.n_rows and 0 <= col < self.n_cols):
            raise InvalidArgument("index outside the matrix")

    def cell(self, row: int, col: int) -> DataFrame:
        self._check(row, col)
        return self.df.filter((F.col("row") == row) & (F.col("col") == col))

    def get(self, row: int, col: int) -> float:
        """The first entry of the cell in order; a cell without one is 0."""
        found = self.cell(row, col)
        first = (found.orderBy("seq") if "seq" in found.columns else found).select("value").take(1)
        return float(first[0][0]) if first else 0.0

    def has_entry(self, row: int, col: int) -> bool:
        return bool(self.cell(row, col).take(1))

    def row_slice(self, row: int) -> DataFrame:
        self._check(row)
        return self.df.filter(F.col("row") == row).select("row", "col", "value").orderBy("col")

    def row_nnz(self, row: int) -> int:
        self._check(row)
        return self.df.filter(F.col("row") == row).count()

    def nnz(self) -> int:
        return self.df.count()

    def memory_estimate(self) -> DataFrame:
        """Bytes of the entries in both layouts, by formula."""
        n = F.count(F.lit(1))
        return self.df.agg(n.alias("nnz"), (n * (2 * INDEX_BYTES + VALUE_BYTES)).alias("coordinate_bytes"), (n * (INDEX_BYTES + VALUE_BYTES) + (self.n_rows + 1) * INDEX_BYTES).alias("compressed_bytes"))

    def scale(self, method: str, n_rows: int, n_cols: int, **options: object) -> SparseMatrix:
        from .resample import scale

        return scale(self, method, n_rows, n_cols, **options)


#: Entries that a builder takes one by one; more belong in DataFrames.
MOST_SINGLE = 1_000_000


class MatrixBuilder:
    """Collects entries on the driver (MOST_SINGLE at most) and DataFrames of entries, in the order they are added; ``finalize`` merges them by a policy."""

    def __init__(self, spark: SparkSession, n_rows: int, n_cols: int):
        self.spark, self.n_rows, self.n_cols = spark, n_rows, n_cols
        self.parts: list[list[tuple[int, int, float]] | DataFrame] = []
        self.added = 0

    def add(self, row: int, col: int, value: float) -> MatrixBuilder:
        if not (0 <= row < self.n_rows and 0 <= col < self.n_cols):
            raise InvalidArgument("an entry lies outside the matrix")
        if self.added >= MOST_SINGLE:
            raise InvalidArgument(f"more than {MOST_SINGLE} single entries: add them as a DataFrame")
        if not self.parts or isinstance(self.parts[-1], DataFrame):
            self.parts.append([])
        self.parts[-1].append((row, col, value))
        self.added += 1
        return self

    def add_batch(self, batch: Iterable[tuple[int, int, float]] | DataFrame) -> MatrixBuilder:
        if isinstance(batch, DataFrame):
            self.parts.append(batch)
        else:
            for r, c, v in batch:
                self.add(r, c, v)
        return self

    def finalize(self, policy: str = "sum") -> SparseMatrix:
        out = SparseMatrix.empty(self.spark, self.n_rows, self.n_cols)
        for part in self.parts:
            if isinstance(part, DataFrame) and "seq" not in part.columns:
                part = part.withColumn("seq", F.monotonically_increasing_id())  # the order in which the frame is read
            out = out.append(out.with_df(part) if isinstance(part, DataFrame) else SparseMatrix.from_entries(self.spark, part, self.n_rows, self.n_cols))
        return out.merged(policy)
