"""Matrix Market coordinate files: reading by Spark's text scan or as a data source, and writing."""

from __future__ import annotations

import io
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import FileError, FormatError, Unsupported
from ..operators.convert import to_csr
from ..operators.matrix import SparseMatrix
from ..operators.validate import coo_violations, csr_violations

#: Words of the banner line; complex values and hermitian matrices are known but not read. Fixed values of the format.
OBJECTS = ("matrix", "vector")
FORMATS = ("coordinate", "array")
VALUES = ("real", "integer", "pattern", "complex")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


@dataclass(frozen=True)
class MtxInfo:
    object: str
    format: str
    value: str
    symmetry: str
    n_rows: int
    n_cols: int
    nnz: int
    #: Lines before the first entry.
    skip: int = 0


def parse_banner(line: str) -> tuple[str, str, str, str]:
    words = line.split()
    if len(words) < 5 or words[0] != "%%MatrixMarket":
        raise FormatError("the first line is no %%MatrixMarket banner")
    for word, known in zip(words[1:5], (OBJECTS, FORMATS, VALUES, SYMMETRIES), strict=True):
        if word not in known:
            raise FormatError(f"unknown word {word!r} in the banner")
    if words[3] == "complex" or words[4] == "hermitian":
        raise Unsupported("complex and hermitian matrices are not read")
    return words[1], words[2], words[3], words[4]


def parse_header(lines: list[str]) -> MtxInfo:
    """From the first lines of a file: the banner, comments, and the line of dimensions."""
    if not lines:
        raise FormatError("the file is empty")
    object_, format_, value, symmetry = parse_banner(lines[0])
    for k, line in enumerate(lines[1:], 1):
        if line.startswith("%"):
            continue
        numbers = line.split()
        wanted = 3 if format_ == "coordinate" else 2
        if len(numbers) < wanted or not all(re.fullmatch(r"\d+", n) for n in numbers[:wanted]):
            raise FormatError(f"line {k + 1} gives no dimensions")
        n_rows, n_cols = int(numbers[0]), int(numbers[1])
        return MtxInfo(object_, format_, value, symmetry, n_rows, n_cols, int(numbers[2]) if wanted == 3 else n_rows * n_cols, k + 1)
    raise FormatError("no line of dimensions")


def read_header(spark: SparkSession, path: str) -> MtxInfo:
    """Reads the file's first lines through Spark, so any store that Spark reads will do; more of them while all are comments."""
    most = 64
    try:
        lines = [r[0] for r in spark.read.text(path).limit(most).collect()]
        while len(lines) == most and all(x.startswith("%") for x in lines[1:]):
            most *= 16
            lines = [r[0] for r in spark.read.text(path).limit(most).collect()]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileError(f"no such file: {path}") from e
        raise
    return parse_header(lines)


def _entries(spark: SparkSession, path: str, info: MtxInfo) -> DataFrame:
    """(seq, line) of the entry lines. The order of a line is its place in the text: partition first, then inside it."""
    lines = spark.read.text(path).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    counts = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per file split
    total, offsets = 0, []
    for r in counts:
        offsets.append((r["part"], total))
        total += r["n"]
    if not offsets:
        return spark.createDataFrame([], "seq long, line string")
    before = spark.createDataFrame(offsets, "part int, before long")
    numbered = lines.join(F.broadcast(before), "part").withColumn("seq", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) - info.skip)
    return numbered.filter((F.col("seq") >= 0) & (F.col("seq") < info.nnz)).select("seq", F.trim("value").alias("line"))


def read_mtx(spark: SparkSession, path: str, strict_compat: bool = False, check: bool = True) -> SparseMatrix:
    """Entries with indices from 0. Pattern entries are 1; symmetric and skew-symmetric files are expanded (with
    ``strict_compat`` skew-symmetric ones are not); lines after the last entry are ignored; fewer lines are an error."""
    info = read_header(spark, path)
    if info.object != "matrix" or info.format != "coordinate":
        raise Unsupported("only coordinate matrices are read")
    words = F.split("line", r"\s+")
    value = F.lit(1.0) if info.value == "pattern" else F.try_element_at(words, F.lit(3)).try_cast("double")
    df = _entries(spark, path, info).select((F.try_element_at(words, F.lit(1)).try_cast("long") - 1).alias("row"), (F.try_element_at(words, F.lit(2)).try_cast("long") - 1).alias("col"), value.cast("float").cast("double").alias("value"), "seq")
    m = SparseMatrix(df, info.n_rows, info.n_cols)
    if check:
        facts = coo_violations(m).first()
        broken = df.filter("row is null or col is null or value is null").take(1)
        if facts["nnz"] < info.nnz:
            raise FormatError(f"{info.nnz} entries are announced, {facts['nnz']} found")
        if broken or facts["out_of_bounds"]:
            raise FormatError("an entry cannot be read or lies outside the matrix")
    if info.symmetry == "symmetric" or info.symmetry == "skew-symmetric" and not strict_compat:
        m = expand_symmetric(m, -1 if info.symmetry == "skew-symmetric" else 1)
    return m


def read_csr(spark: SparkSession, path: str, dedup: str = "sum") -> DataFrame:
    """A file in the row-compressed layout (row, cols, vals); entries of one cell are merged by the policy ``dedup``."""
    return to_csr(read_mtx(spark, path), dedup=dedup)


def expand_symmetric(m: SparseMatrix, sign: int = 1) -> SparseMatrix:
    """The entries and the mirror images of those off the diagonal."""
    mirror = m.df.filter("row <> col").withColumns({"row": F.col("col"), "col": F.col("row"), "value": F.col("value") * sign})
    return m.with_df(m.df.unionByName(mirror))


def entry_lines(df: DataFrame) -> DataFrame:
    """Indices from 1 and the shortest text that reads back as the same single-precision value."""
    return df.select(F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("value").cast("float").cast("string")).alias("line"))


def write_mtx(m: SparseMatrix, path: str, compressed: bool = False, single_file: bool = True, comment: str = "written by latticework") -> None:
    """Sorted parts (range partitioning), then one file with the header, or with ``single_file=False`` a folder of parts and a file header.txt.

    ``compressed`` asks for one entry a cell. Values that are null, NaN or infinite are an error.
    """
    spark = m.spark
    found = coo_violations(m).first()
    if found["out_of_bounds"] or found["bad_values"]:
        raise FormatError("entries outside the matrix or without a finite value cannot be written")
    if compressed and csr_violations(m).first()["duplicate_cells"]:
        raise FormatError("the row-compressed layout holds one entry a cell")
    header = f"%%MatrixMarket matrix coordinate real general\n% {comment}\n{m.n_rows} {m.n_cols} {found['nnz']}\n"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    parts = f"{path}.parts" if single_file else path
    entry_lines(m.df.repartitionByRange("row", "col").sortWithinPartitions("row", "col")).write.mode("overwrite").text(parts)
    fs = fs_path(path).getFileSystem(conf)
    target = fs.create(fs_path(path if single_file else f"{path}/header.txt"), True)
    target.write(bytearray(header, "utf-8"))
    if single_file:
        names = sorted(s.getPath().toString() for s in fs.listStatus(fs_path(parts)) if s.getPath().getName().startswith("part-"))
        for name in names:  # streamed by the JVM, part after part
            source = fs.open(fs_path(name))
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, target, 1 << 16, False)
            source.close()
    target.close()
    if single_file:
        fs.delete(fs_path(parts), True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, on any file system that Spark writes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


class MtxDataSource(DataSource):
    """``spark.read.format("mtx").load(path)``: local and shared paths and the stores that Arrow's file systems reach; read_mtx reads
    all that Spark's text scan does. Planning counts the lines once; entries are read split by split."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "row long, col long, value double"

    def reader(self, schema) -> MtxReader:
        return MtxReader(self.options)


#: Bytes that are read at once.
_BUFFER = 1 << 20


class MtxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.splits = int(options.get("splits", "8"))
        with self._open() as f:
            lines = []
            while line := f.readline():
                lines.append(line.decode())
                if not line.startswith(b"%"):
                    break
            self.first = f.tell()
            self.last = f.seek(0, 2)
        self.info = parse_header(lines)
        if self.info.object != "matrix" or self.info.format != "coordinate":
            raise Unsupported("only coordinate matrices are read")
        if self.info.symmetry == "symmetric":
            self.signs: tuple[int, ...] = (1,)
        else:
            self.signs = (-1,) if self.info.symmetry == "skew-symmetric" else ()

    def _open(self) -> io.BufferedReader:
        from pyarrow import ArrowInvalid, fs

        if self.path.startswith("file:"):
            store, name = fs.LocalFileSystem(), "/" + self.path.removeprefix("file:").lstrip("/")
        elif "://" in self.path:
            try:
                store, name = fs.FileSystem.from_uri(self.path)
            except ArrowInvalid as e:
                raise Unsupported(f"this source cannot open {self.path}; read_mtx can") from e
        else:
            store, name = fs.LocalFileSystem(), self.path
        return io.BufferedReader(store.open_input_file(name), _BUFFER)

    def _lines(self, f: io.BufferedReader, a: int, b: int) -> Iterator[bytes]:
        """Lines that begin in a split and are not blank."""
        if a > self.first:
            f.seek(a - 1)
            f.readline()
        else:
            f.seek(self.first)
        at = f.tell()
        while at < b and (line := f.readline()):
            at += len(line)
            if not line.isspace():
                yield line

    def partitions(self) -> list[InputPartition]:
        edges = [self.first + (self.last - self.first) * k // self.splits for k in range(self.splits + 1)]
        out, before = [], 0
        with self._open() as f:
            for a, b in zip(edges, edges[1:], strict=False):
                out.append(InputPartition((a, b, before)))
                before += sum(1 for _ in self._lines(f, a, b))
        if before < self.info.nnz:
            raise FormatError(f"{self.info.nnz} entries are announced, {before} found")
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b, before = partition.value
        with self._open() as f:
            for line in itertools.islice(self._lines(f, a, b), max(0, self.info.nnz - before)):  # lines after the last entry are ignored
                words = line.split()
                try:
                    row, col = int(words[0]) - 1, int(words[1]) - 1
                    value = 1.0 if self.info.value == "pattern" else float(words[2])
                except (IndexError, ValueError) as e:
                    raise FormatError(f"no entry: {line!r}") from e
                if not (0 <= row < self.info.n_rows and 0 <= col < self.info.n_cols):
                    raise FormatError("an entry lies outside the matrix")
                yield row, col, value
                if row != col:
                    for sign in self.signs:
                        yield col, row, sign * value


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MtxDataSource)
