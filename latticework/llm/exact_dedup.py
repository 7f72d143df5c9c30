"""Exact dedup by a log-structured merge index over text digests; DataFrame functions only.

Flush: every scan task is a memtable that it writes out as one run, sorted by digest; nothing is shuffled. Compaction:
level by level, FAN_IN runs at a time are merged by a sorted aggregation into one run of the next level, which keeps for
each digest the best identifier and the number of entries, until one run is left; a hot digest has one entry in each run,
so no task ever meets more than FAN_IN entries of it. Filters: a bitmap in pieces by hash range, sized by the number of
digests with more than one entry, says which rows are hits. Verification: only the texts of hits move, and the least and
greatest text of each digest have to be the same bytes. Digests whose texts differ are grouped anew by the text itself.

Defined results: a null text counts as empty; texts that are empty after normalising are equal to each other;
the longest original text stays, ties go to the smallest id, null ids last; of rows that repeat even the id one is kept;
an empty table gives an empty result; other columns are never read by the index, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bit_filter, discard, materialize, pick, probe

#: Runs that one merge takes in.
FAN_IN = 16


def normalised(text: Column) -> Column:
    """The text without any of the six blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return pick(docs, doc_id=id_col, norm=normalised(text), n_points=F.length(F.coalesce(text, F.lit("")))).withColumn("digest", F.unhex(F.sha2("norm", 256)))


def _rank(n_points: Column, doc_id: Column) -> list[Column]:
    """What the row that stays is least by."""
    return [(-n_points).alias("neg"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id")]


@dataclass
class DigestIndex:
    """runs: one row per document; compacted: the last level, one row per digest; filter: the digests with several entries;
    collided: digests of unlike texts, or None."""

    runs: DataFrame
    compacted: DataFrame
    filter: DataFrame
    collided: DataFrame | None

    def hits(self, digested: DataFrame) -> DataFrame:
        return probe(digested, self.filter, "digest")


def compact(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """From runs (run, digest, best, n) the one run that merging them level by level gives: (digest, best, n), n summed, best the least."""
    spark = runs.sparkSession
    level, left = runs, (runs.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        left = -(-left // fan_in)
        merged = level.groupBy(F.expr(f"run div {fan_in}").alias("run"), "digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        merged = materialize(spark, merged.sortWithinPartitions("run", "digest"), "lsm-level")
        discard(spark, level)
        level = merged
        if left <= 1:
            return level.select("digest", "best", "n")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DigestIndex:
    spark = docs.sparkSession
    digested = _digested(docs, id_col, text_col)
    memtables = digested.select("doc_id", "digest", "n_points", F.spark_partition_id().cast("long").alias("run"), F.monotonically_increasing_id().alias("entry"))
    runs = materialize(spark, memtables.sortWithinPartitions("digest"), "lsm-runs")
    best = F.struct(*_rank(F.col("n_points"), F.col("doc_id")), F.col("entry"))
    last = compact(runs.select("run", "digest", best.alias("best"), F.lit(1).cast("long").alias("n")))
    compacted = materialize(spark, last.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.entry").alias("keep_entry"), (-F.col("best.neg")).alias("keep_points"), F.col("n").alias("group_size")), "lsm-compacted")
    index = DigestIndex(runs, compacted, bit_filter(compacted.filter("group_size > 1"), "digest"), None)
    # Byte verification: the extremes of each digest's texts are the same bytes, or the digest collided.
    differ = index.hits(digested).filter("hit").groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("differ"))
    collided = materialize(spark, differ.filter("differ").select("digest"), "lsm-collided")
    index.collided = collided if collided.take(1) else None
    return index


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, id_col, text_col)
    # The compacted side is unique by digest; a hot digest's entries are split by adaptive execution.
    joined = index.runs.join(index.compacted, "digest")
    if index.collided is not None:
        joined = joined.join(index.collided, "digest", "left_anti")
    out = joined.select("doc_id", "keep_id", "group_size", (F.col("entry") == F.col("keep_entry")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if index.collided is not None:
        out = out.unionByName(_by_text(index.hits(_digested(docs, id_col, text_col)).filter("hit").join(index.collided, "digest", "left_semi")))
    return out


def _by_text(rows: DataFrame) -> DataFrame:
    """Documents whose digest stands for several texts, grouped by the texts."""
    rows = materialize(rows.sparkSession, rows.withColumn("entry", F.monotonically_increasing_id()), "lsm-collisions")
    best = F.min(F.struct(*_rank(F.col("n_points"), F.col("doc_id")), F.col("entry")))
    groups = rows.groupBy("digest", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["digest", "norm"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("entry") == F.col("best.entry")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``. Texts that no other row shares are not shuffled."""
    index = build_index(docs, id_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(f"`{text_col}`")
    points = F.length(F.coalesce(text, F.lit("")))
    probed = index.hits(docs.select(row, F.unhex(F.sha2(normalised(text), 256)).alias("digest"), points.alias("points")))
    alone = probed.filter(~F.col("hit")).select("row.*")
    hits = probed.filter("hit")
    if index.collided is not None:  # never seen with SHA-256; exact all the same: one row of each text
        apart = hits.join(index.collided, "digest", "left_semi").withColumn("norm", normalised(F.col(f"row.`{text_col}`")))
        rank = F.struct(*_rank(F.col("points"), F.col(f"row.`{id_col}`")))
        alone = alone.unionByName(apart.groupBy("norm").agg(F.min_by("row", rank).alias("row")).select("row.*"))
        hits = hits.join(index.collided, "digest", "left_anti")
    shared = hits.join(index.compacted, "digest").filter(F.col(f"row.`{id_col}`").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")))
    repeats = index.runs.join(index.compacted.filter("group_size > 1"), "digest")
    repeats = repeats.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")) & (F.col("entry") != F.col("keep_entry")))
    if repeats.take(1):  # rows that repeat id, text and length of the row that stays
        shared = shared.dropDuplicates(["digest"])
    return alone.unionByName(shared.select("row.*"))
