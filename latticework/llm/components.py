"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """From edges (a, b) of long ids: (node, component), the least id that can be reached; nodes without edges do not appear.

    Goes on until only stars are left, however many rounds that takes; with ``rounds``, not being done by then is an error.

    Every step writes its edges to the shared folder. A hot node's rows are pre-aggregated for the minimum, and the
    join that follows is one that adaptive execution can split.
    """
    spark = edges.sparkSession
    current = materialize(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    if current.take(1):
        for _ in itertools.count() if rounds is None else range(rounds):
            step = materialize(spark, _small_star(_large_star(current)), "cc")
            # Stars only: no centre is a leaf, and each leaf has one centre.
            nodes = step.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(step.select(F.col("b").alias("x"), F.lit(0).alias("up")))
            per = nodes.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("centre"))
            done = not per.filter("ups > 1 or (ups = 1 and centre = 0)").take(1)
            discard(spark, current)
            current = step
            if done:
                break
        else:
            raise RuntimeError(f"connected components are not done after {rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
