"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame and SQL functions only.

Targets: the sources share ``ratio`` times all words by weight, none above ``max_repeat`` times its size; what
is cut off goes to the others by weight (water filling, closed form over the sources sorted by size/weight).
Schedule: slot k falls on the golden-ratio point frac(k * phi), in 31-bit fixed point; the source whose piece of the
cumulated target shares holds the point gets the slot, and its rank among the source's slots is the number of the block
that it takes. Blocks: ``block`` words each of a source's shuffled stream, in which every document stands once per pass.
The schedule alone decides what is in the mix: a block without a slot is not taken, a slot past the stream's end
(at most a few, where a target is the whole stream) takes nothing. A source's words come within a few blocks of its
target, as the points' discrepancy is that small.

Positions and ranks are prefix sums in levels of PIECE rows, so a source with a third of all rows is dealt over many
tasks and no window outgrows a piece.

Defined results: a null text has size 0 and is never taken; null is a source of its own, last in order; rows
that repeat are rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize, pick

#: Weights by the rank of the source, repeating.
WEIGHTS = (5, 2, 1)
RATIO, MAX_REPEAT = 1.5, 2
#: Words in a block: total / 2**20, between 1 and 1024.
SLOTS, MAX_BLOCK = 1 << 20, 1024
#: Rows or slots that share one window, at each level of the sums.
PIECE = 1 << 10
#: Sources are broadcast up to this number (some 100 bytes each); beyond it they are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: The golden ratio in fixed point: the points are multiples of 1 / 2**POINT_BITS, and no product outgrows a long.
POINT_BITS = 31
GOLDEN = round((math.sqrt(5) - 1) / 2 * (1 << POINT_BITS))
#: Bits of a document's place in the shuffled order, from the MD5 of its id and the seed.
PLACE_DIGITS, SEED = 15, 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From rows (source, size): source, source_size, n_docs, weight, target. Windows here run over sources, not rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int") + 1)
    ranked = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeat)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(ratio)) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("level", level)
    # The first source, by cap per weight, that its share does not fill sets the level of all that follow.
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    filled = filled.withColumn("common", level)
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("common")), F.col("cap").cast("double"))
    return filled.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def _running(df: DataFrame, key: str, order: list, value: str, out: str, n_pieces: int) -> DataFrame:
    """Sum of ``value`` over the rows before, within ``key`` by ``piece`` (numbered up to n_pieces) and then ``order``."""
    pieces = df.groupBy(key, "piece").agg(F.sum(value).alias("piece_sum"))
    if n_pieces > PIECE:
        above = pieces.withColumn("nth", F.col("piece")).withColumn("piece", F.expr(f"piece div {PIECE}"))
        pieces = _running(above, key, ["nth"], "piece_sum", "offset", n_pieces // PIECE + 1).withColumn("piece", F.col("nth"))
    else:
        before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.withColumn("offset", F.coalesce(F.sum("piece_sum").over(before), F.lit(0)))
    pieces = pieces.select(F.col(key).alias("p_key"), F.col("piece").alias("p_piece"), "offset")
    inner = Window.partitionBy(key, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = local.join(pieces, (F.col(key) == F.col("p_key")) & (F.col("piece") == F.col("p_piece")))
    # The upper levels' sum is itself named offset: it is chosen, not what is left after others are dropped.
    return joined.select(*df.columns, (F.col("offset") + F.col("local")).alias(out))


def place(doc_id: Column, seed: int = SEED) -> Column:
    """Where a document stands in the shuffled order: a number of 4 * PLACE_DIGITS bits; a null id counts as the empty text."""
    digits = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digits, 1, PLACE_DIGITS), 16, 10).cast("long")


@dataclass
class MixingPlan:
    """sources: a row per source with its number k, target and cumulated shares; positions: a row per document with its
    place in its source's stream; slots: k, j (the block that the slot takes), slot; block: words in a block."""

    sources: DataFrame
    positions: DataFrame
    slots: DataFrame
    block: int
    few: Callable[[DataFrame], DataFrame]


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> MixingPlan:
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = pick(docs, doc_id=id_col, source=source_col, size=F.regexp_count(text, F.lit(WORD)).cast("long"))
    rows = materialize(spark, rows, "mix-sizes")
    targets = materialize(spark, source_targets(rows, weights, ratio, max_repeat), "mix-targets")
    numbered = targets.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    hi = F.sum("target").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    sources = materialize(spark, numbered.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("target")), "mix-sources")
    facts = sources.agg(F.count(F.lit(1)).alias("n"), F.max("hi").alias("total"), F.max("n_docs").alias("docs")).first()
    n_sources, total = facts["n"], float(facts["total"] or 0.0)
    few = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    block = int(min(MAX_BLOCK, max(1, total // SLOTS)))

    # Shuffled streams: order by the place, cut into pieces of about PIECE rows.
    src = sources.select(F.col("source").alias("s_source"), "k", "source_size", "n_docs", "target")
    placed = rows.join(few(src), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source").withColumn("place", place(F.col("doc_id"), seed))
    span = F.lit(float(1 << 4 * PLACE_DIGITS))
    placed = placed.withColumn("piece", F.floor(F.col("place") / span * F.ceil(F.col("n_docs") / PIECE)))
    positions = _running(placed, "k", ["place", "doc_id", "size"], "size", "start", (facts["docs"] or 0) // PIECE + 1)
    tie = Window.partitionBy("k", "piece").orderBy("place", "doc_id", "size")
    positions = materialize(spark, positions.withColumn("nth", F.row_number().over(tie)).drop("n_docs"), "mix-positions")

    # Slots: golden-ratio points through the cumulated shares, by equi-join on cells of the unit interval.
    n_slots = math.ceil(total / block) if total else 0
    cells = 1 << max(4, (4 * n_sources).bit_length())
    edge = lambda c: F.floor(F.col(c) / F.lit(total or 1.0) * F.lit(float(1 << POINT_BITS)))
    pieces = sources.filter("target > 0").select("k", edge("lo").alias("u_lo"), F.when(F.col("hi") >= total, F.lit(1 << POINT_BITS)).otherwise(edge("hi")).alias("u_hi"))
    width = (1 << POINT_BITS) // cells
    pieces = pieces.filter("u_hi > u_lo").withColumn("cell", F.explode(F.expr(f"sequence(u_lo div {width}, (u_hi - 1) div {width})")))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u"))
    slots = slots.withColumn("cell", F.expr(f"u div {width}")).join(few(pieces), "cell").filter("u >= u_lo and u < u_hi")
    slots = slots.select("k", "slot", F.lit(1).cast("long").alias("one")).withColumn("piece", F.expr(f"slot div {4 * PIECE}"))
    slots = materialize(spark, _running(slots, "k", ["slot"], "one", "j", n_slots // (4 * PIECE) + 1).select("k", "j", "slot"), "mix-slots")
    discard(spark, rows, targets)
    return MixingPlan(sources, positions, slots, block, few)


def golden_point(slot: Column) -> Column:
    """The point of a slot, as a multiple of 1 / 2**POINT_BITS."""
    return F.pmod(F.pmod(slot + 1, F.lit(1 << POINT_BITS)) * F.lit(GOLDEN), F.lit(1 << POINT_BITS))


def schedule(plan: MixingPlan, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """A row per piece of a document inside a block that has a slot: doc_id, source, k, piece, nth (the document's place), pass,
    j, slot (its turn in the mix), from_word, to_word."""
    words = plan.positions.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    words = words.withColumn("first", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("end", F.col("first") + F.col("size"))
    reach = plan.slots.groupBy("k").agg((F.max("j") + 1).alias("blocks")).select(F.col("k").alias("r_k"), "blocks")  # whole passes past the last slot make no rows
    words = words.join(plan.few(reach), F.col("k") == F.col("r_k")).filter(F.col("first") < F.col("blocks") * plan.block)
    held = words.withColumn("j", F.explode(F.expr(f"sequence(first div {plan.block}, (end - 1) div {plan.block})")))
    from_word = F.greatest("first", F.col("j") * plan.block) - F.col("first")
    to_word = F.least("end", (F.col("j") + 1) * plan.block) - F.col("first")
    held = held.select("doc_id", "source", "k", "piece", "nth", "pass", "j", from_word.alias("from_word"), to_word.alias("to_word"))
    return held.join(plan.slots, ["k", "j"])


def mixing_counts(docs: DataFrame, **options: object) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (its words in blocks that have a slot), first_slot (-1 if none)."""
    plan = mixing_plan(docs, **options)
    taken = schedule(plan, options.get("max_repeat", MAX_REPEAT)).groupBy("k", "piece", "nth").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"), F.min("slot").alias("first_slot"))
    out = plan.positions.join(taken, ["k", "piece", "nth"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_slot", F.lit(-1)).alias("first_slot"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options: object) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each pass that takes words of a document.

    The blocks with slots are the first ones of a source's stream, so the schedule says for each source how many passes
    are whole and where in the shuffled order the last one ends: a few numbers a source, broadcast, which let a narrow step filter
    and repeat the documents without moving a text. A document that a block's edge cuts is given whole. Rows that share an id
    share one verdict.
    """
    plan = mixing_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    blocks = plan.slots.groupBy("k").agg((F.max("j") + 1).alias("blocks"))
    repeats = options.get("max_repeat", MAX_REPEAT)
    taken = F.least(F.coalesce("blocks", F.lit(0)) * plan.block, F.col("source_size") * repeats)
    per = plan.sources.filter("source_size > 0").join(blocks, "k", "left").select("source", "k", F.expr("source_size").alias("whole"), taken.alias("words"))
    per = per.select("source", "k", F.expr("words div whole").alias("passes"), (F.col("words") % F.col("whole")).alias("rest"))
    rest = plan.few(per.select(F.col("k").alias("r_k"), "rest"))
    last = plan.positions.join(rest, F.col("k") == F.col("r_k")).filter((F.col("start") < F.col("rest")) & (F.col("size") > 0))
    last = last.groupBy("k").agg(F.max(F.struct("place", "doc_id")).alias("last"))
    per = materialize(docs.sparkSession, per.join(last, "k", "left").select(F.col("source").alias("lw_source"), F.col("passes").alias("lw_passes"), F.col("last").alias("lw_last")), "mix-ends")
    discard(docs.sparkSession, plan.positions, plan.slots, plan.sources)
    here = F.struct(place(F.col(f"`{id_col}`"), seed).alias("place"), F.col(f"`{id_col}`").alias("doc_id"))
    times = F.col("lw_passes") + F.when(here <= F.col("lw_last"), 1).otherwise(0)
    out = docs.filter(F.col(f"`{text_col}`").rlike(WORD)).join(plan.few(per), F.col(f"`{source_col}`").eqNullSafe(F.col("lw_source")))
    out = out.withColumn("lw_times", times).filter("lw_times > 0").withColumn("lw_pass", F.explode(F.expr("sequence(1, lw_times)")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
