"""Shared pieces: scratch tables in the cluster's shared folder, column hygiene, sampling by hash, filters, worker state."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of every text contract: blank and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; a folder of our own only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        base = os.path.join(tempfile.gettempdir(), f"latticework-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/latticework/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lw_path = path
    return out


def discard_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_lw_path", None):
            discard_path(spark, path)


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Project to the named inputs only, so that no other column of the caller can clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def crc_mod(column: str | Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % m


def share(column: Column, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the value only."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11) / F.lit(float(1 << 53))


def by_bytes(batch, column: str, most: int = 4 << 20) -> Iterator:
    """Slices of an Arrow batch whose texts hold about ``most`` bytes together; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes.astype(np.int64)), 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


_HELD: dict[tuple[str, Hashable], object] = {}


def per_worker(kind: str, key: Hashable, make: Callable[[], object]):
    """What ``make()`` gives, kept by a Python worker from task to task; one value at a time."""
    if (kind, key) not in _HELD:
        release_worker()
        _HELD[kind, key] = make()
    return _HELD[kind, key]


def release_worker() -> None:
    """Drop what the worker keeps and give free pages back: its memory belongs to the tasks of another operator."""
    _HELD.clear()
    trim_worker()


def trim_worker() -> None:
    """Give a worker's free pages back, as far as they are whole."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        _trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """Executors collect garbage and give what their heaps no longer hold back to the system, for the Python workers of the next operator.

    A heap that shuffles have filled up keeps its pages otherwise. One short task a core; an executor that gets none keeps its heap.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


#: log2 of the bits in a filter: least and greatest. 2**27 bits are 4 096 pieces of 4 KB: what is broadcast never exceeds 16 MB.
#: A filter has 16 bits a key; beyond some 100 M keys more and more rows count as hits, which costs a shuffle of them, not results.
FEWEST_BITS, MOST_BITS, KEY_BITS = 23, 27, 4
_PIECE = 1 << 15


def _slot(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of hashed keys, in pieces that each stand for a range of the hash: (piece, bits). Its size follows the number of keys."""
    bits = min(MOST_BITS, max(FEWEST_BITS, keys.count().bit_length() + KEY_BITS))
    slots = keys.select(_slot(key, bits).alias("slot"))
    made = slots.groupBy(F.floor(F.col("slot") / _PIECE).alias("piece")).agg(F.expr(f"bitmap_construct_agg(slot % {_PIECE})").alias("bits"))
    out = materialize(keys.sparkSession, made.coalesce(1), "filter")
    out._lw_bits = bits
    return out


def probe(df: DataFrame, filt: DataFrame, key: str) -> DataFrame:
    """``df`` with ``hit``: false if the key is certainly not in the filter. A false positive costs time, not results."""
    bits = filt._lw_bits
    at = F.col("lw_slot") % _PIECE
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8).cast("int") + 1)
    out = df.withColumn("lw_slot", _slot(key, bits)).withColumn("piece", F.floor(F.col("lw_slot") / _PIECE)).join(F.broadcast(filt), "piece", "left")
    return out.withColumn("hit", F.when(F.col("bits").isNull(), False).otherwise(byte.bitwiseAND(mask) != 0)).drop("lw_slot", "piece", "bits")
