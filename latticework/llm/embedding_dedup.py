"""Embedding near-dedup over an inverted multi-index.

Vectors that are equal number by number are one class. Each half of the normalised vectors has a codebook of up to MOST_CODES
codes (16 MB for vectors of 128 components; k-means on about SAMPLE classes, SAMPLE_CODE to a code where there are more codes); a pair of codes is a cell of the product grid, and every class is in the index. A class visits
cells by the multi-sequence algorithm (a heap over the two sorted distance lists), nearest first; how many is fitted
once: PROBES classes, chosen by hash, are compared with all classes by brute force, MOST_PROBES if fewer than LINKED of
them have links, and the visits stop where TARGET of their links are reached. Where links are still too few to tell,
the visits also reach TARGET of COPIES perturbed copies of each of PROBES classes, made at the least cosine that links.
Candidates are verified by cosine in double precision.

Cells and visits travel in blocks of at most BLOCK rows; blocks of a cell meet by an equi-join whose hot cells adaptive
execution can split. A block pair gives link counts and a spanning forest of its links, never pairs, so a dense group
costs no more rows than it has members.

Defined results: a vector that is null, zero, or holds a null or non-finite number links with nothing; vectors of each
length that occurs are compared among themselves, with one index a length (vectors of one component link by sign, without
an index); copies link with each other; rows that repeat an id are rows of their own with one component; an empty table gives an empty result; the label and other columns are not read.
"""

from __future__ import annotations

import logging
import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, pick, share
from .components import connected_components

log = logging.getLogger(__name__)

LEAST = 0.95
SAMPLE, PROBES, TARGET = 16_384, 256, 0.9999
MOST_PROBES, LINKED, COPIES = 2048, 64, 8
#: Classes that share a cell on average; the codebooks grow with the root of the classes.
PER_CELL, MOST_CODES, KMEANS_ROUNDS = 48, 1 << 14, 8
#: Sampled classes to a code.
SAMPLE_CODE = 8
BLOCK = 256


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    top = np.abs(rows).max(1, keepdims=True)
    rows = rows / np.where(top > 0, top, 1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def kmeans(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(KMEANS_ROUNDS):
        codes = _distances(rows, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, codes, rows)
        counts = np.bincount(codes, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(distances: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` least distances, nearest first."""
    if most >= len(distances):
        return distances.argsort(kind="stable")
    some = np.argpartition(distances, most - 1)[:most]
    return some[distances[some].argsort(kind="stable")]


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1), 0)


class MultiIndex:
    """Two codebooks; a cell is code 1 times the size of codebook 2 plus code 2."""

    def __init__(self, sample: np.ndarray, k: int):
        self.dim = sample.shape[1]
        self.half = self.dim // 2
        self.books = [kmeans(sample[:, : self.half], k, 1), kmeans(sample[:, self.half :], k, 2)]

    def lists(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(rows[:, : self.half], self.books[0]), _distances(rows[:, self.half :], self.books[1])

    def cells(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return d1.argmin(1) * len(self.books[1]) + d2.argmin(1)

    def visits(self, d1: np.ndarray, d2: np.ndarray, most: int) -> list[list[int]]:
        """Multi-sequence traversal: for each row the ``most`` cells of least distance, in order."""
        wide = len(self.books[1])
        out = []
        for i in range(len(d1)):
            o1, o2 = _nearest(d1[i], most), _nearest(d2[i], most)  # no visit goes further down a list than there are visits
            a, b = d1[i][o1].tolist(), d2[i][o2].tolist()
            heap, pushed, found = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
            while heap and len(found) < most:
                _, p, q = heappop(heap)
                found.append(int(o1[p]) * wide + int(o2[q]))
                for n in ((p + 1, q), (p, q + 1)):
                    if n[0] < len(a) and n[1] < len(b) and n not in pushed:
                        pushed.add(n)
                        heappush(heap, (a[n[0]] + b[n[1]], *n))
            out.append(found)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, least id of its group) for the groups that a block pair's links make; ids may be on both sides."""
    if not links.any():
        return []
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(a, np.where(links, b[None, :], top).min(1))
        nb = np.minimum(b, np.where(links, na[:, None], top).min(0))
        if (na == a).all() and (nb == b).all():
            break
        a, b = na, nb
    pairs = {(x, y) for x, y in zip([*left.tolist(), *right.tolist()], [*a.tolist(), *b.tolist()], strict=True) if x != y}
    return sorted(pairs)


def _ranks(index: MultiIndex, d1: np.ndarray, d2: np.ndarray, partners: np.ndarray) -> np.ndarray:
    """How many cells a row with these two distance lists visits until it reaches each partner's cell."""
    e1, e2 = index.lists(partners)
    cells, at = np.unique(index.cells(e1, e2), return_inverse=True)
    wide = len(index.books[1])
    cost = d1[cells // wide] + d2[cells % wide]
    nearer = np.searchsorted(np.sort(d2), (cost[:, None] - d1[None, :]) + 1e-12 * cost[:, None], side="right")
    return nearer.sum(1)[at]


def _reach(ranks: np.ndarray, counts: np.ndarray) -> int:
    """The least visits that reach TARGET of the counted ranks."""
    order = np.argsort(ranks)
    return int(ranks[order][np.searchsorted(np.cumsum(counts[order]), TARGET * counts.sum())])


def copies_ranks(index: MultiIndex, rows: np.ndarray, least: float) -> np.ndarray:
    """Ranks of COPIES copies of each row, turned in random directions to the cosine ``least``."""
    rng, out = np.random.default_rng(7), []
    d1, d2 = index.lists(rows)
    for i, row in enumerate(rows):
        turn = rng.normal(size=(COPIES, len(row)))
        turn = unit(turn - (turn @ row)[:, None] * row)
        out.append(_ranks(index, d1[i], d2[i], least * row + math.sqrt(max(0.0, 1 - least * least)) * turn))
    return np.concatenate(out)


def fit_visits(classes: DataFrame, n_classes: int, index: Broadcast, least: float) -> int:
    """How far to go: brute force for the probes, against all classes, and copies where too few probes have links."""
    spark = classes.sparkSession
    for most in (PROBES, MOST_PROBES):
        rows = classes.orderBy(F.xxhash64("cid", F.lit(5)), "cid").limit(most).select("cid", "v").collect()
        probes = spark.sparkContext.broadcast((np.array([r["cid"] for r in rows]), unit(np.array([r["v"] for r in rows]))))

        def ranks(batches: Iterator[pa.RecordBatch], probes: Broadcast = probes) -> Iterator[pa.RecordBatch]:
            ids, q = probes.value
            d1, d2 = index.value.lists(q)
            found: Counter = Counter()
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    cid, v = part.column("cid").to_numpy(), unit(_matrix(part.column("v")))
                    links = (q @ v.T >= least) & (ids[:, None] != cid[None, :])
                    for i in np.flatnonzero(links.any(1)).tolist():
                        found.update((i, r) for r in _ranks(index.value, d1[i], d2[i], v[links[i]]).tolist())
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int64()), pa.array([r for _, r in keys], pa.int64()), pa.array([found[k] for k in keys], pa.int64())], ["probe", "rank", "n"])

        seen = materialize(spark, classes.select("cid", "v").mapInArrow(ranks, "probe long, rank long, n long"), "imi-ranks")
        linked = seen.select("probe").distinct().count()
        if linked >= LINKED or len(rows) >= n_classes:
            break
    found = seen.groupBy("rank").agg(F.sum("n").alias("n")).collect()
    discard(spark, seen)
    visits = 2
    if found:
        visits = max(visits, _reach(np.array([r["rank"] for r in found]), np.array([r["n"] for r in found])))
    if linked < LINKED and len(rows) < n_classes:
        apart = copies_ranks(index.value, probes.value[1][:PROBES], least)
        visits = max(visits, _reach(apart, np.ones(len(apart), np.int64)))
    visits += -(-visits // 2)  # half as many again, for what the probes did not show
    log.info("%d of %d classes probed, %d with links; %d cells visited", len(rows), n_classes, linked, visits)
    return visits


def class_links(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """From classes (cid, n, v): (cid, links to vectors of other classes) and edges (a, b) of a spanning forest."""
    spark = classes.sparkSession
    n_classes = classes.count()
    k = min(MOST_CODES, max(1, math.ceil(math.sqrt(n_classes / PER_CELL))))
    wanted = max(SAMPLE, SAMPLE_CODE * k)
    sample = classes.filter(share(F.col("cid"), 11) < min(1.0, wanted / max(n_classes, 1))).select("cid", "v").orderBy("cid").limit(2 * wanted).collect()
    if not sample:
        sample = classes.select("cid", "v").orderBy("cid").limit(wanted).collect()
    index = spark.sparkContext.broadcast(MultiIndex(unit(np.array([r["v"] for r in sample])), k))  # 2 x MOST_CODES half vectors at most
    visits = fit_visits(classes, n_classes, index, least)

    kind = dict(classes.dtypes)["v"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                d1, d2 = index.value.lists(unit(_matrix(part.column("v"))))
                yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("n"), part.column("v"), pa.array(index.value.cells(d1, d2), pa.int64()), pa.array(index.value.visits(d1, d2, visits), pa.list_(pa.int64()))], ["cid", "n", "v", "cell", "visits"])

    placed = materialize(spark, classes.mapInArrow(assign, f"cid long, n long, v {kind}, cell long, visits array<long>"), "imi-placed")
    # Blocks: rows of a cell, and rows that visit a cell, in pieces of about BLOCK by hash.
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    fanned = placed.select("cid", "n", "v", F.col("cell").alias("own"), "visits", F.explode("visits").alias("cell"))
    callers = fanned.groupBy("cell").agg(F.count(F.lit(1)).alias("called"))
    sizes = sizes.join(callers, "cell")
    piece = lambda c: F.pmod(F.xxhash64("cid", F.lit(3)), F.ceil(F.col(c) / BLOCK)).alias("piece")
    held = placed.select("cid", "n", "v", "cell", "visits").join(sizes, "cell").select("cell", piece("held"), F.struct("cid", "n", "v", "visits").alias("r"))
    held = held.groupBy("cell", "piece").agg(F.collect_list("r").alias("rows")).select("cell", F.col("rows").alias("held"))
    calls = fanned.join(sizes, "cell").select("cell", piece("called"), F.struct("cid", "n", "v", F.col("own")).alias("r"))
    calls = calls.groupBy("cell", "piece").agg(F.collect_list("r").alias("rows")).select("cell", F.col("rows").alias("calls"))
    held, calls = materialize(spark, held, "imi-held"), materialize(spark, calls, "imi-calls")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("held"), batch.column("calls"), strict=True):
                hs, cs = h.values, c.values
                hid, hn, hv = hs.field("cid").to_numpy(), hs.field("n").to_numpy(), unit(_matrix(hs.field("v")))
                cid, cn, cv = cs.field("cid").to_numpy(), cs.field("n").to_numpy(), unit(_matrix(cs.field("v")))
                links = (cv @ hv.T >= least) & (cid[:, None] != hid[None, :])
                if not links.any():
                    continue
                # A link that the other side does not find by itself counts for both here.
                lists, own = _matrix(hs.field("visits")), cs.field("own").to_numpy()
                mutual = (lists[None, :, :] == own[:, None, None]).any(2) if links.sum() * 8 > links.size else None
                if mutual is None:
                    i, j = np.nonzero(links)
                    mutual = np.zeros_like(links)
                    mutual[i, j] = (lists[j] == own[i][:, None]).any(1)
                ids = np.concatenate([cid, hid])
                sums = np.concatenate([links @ hn, (links & ~mutual).T @ cn])
                pairs = forest(links, cid, hid)
                some = sums > 0
                yield pa.RecordBatch.from_arrays([pa.array([*ids[some].tolist(), *(a for a, _ in pairs)], pa.int64()), pa.array([*sums[some].tolist(), *[0] * len(pairs)], pa.int64()), pa.array([*[None] * int(some.sum()), *(b for _, b in pairs)], pa.int64())], ["cid", "links", "other"])

    found = materialize(spark, calls.join(held.hint("merge"), "cell").select("held", "calls").mapInArrow(verify, "cid long, links long, other long"), "imi-links")
    counts = found.filter("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    return counts, found.filter("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))


def sign_links(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``class_links`` for vectors of one component: the cosine is 1 where signs are equal and -1 elsewhere."""
    signed = classes.select("cid", "n", (F.col("v")[0] > 0).alias("up"))
    sides = signed.groupBy("up").agg(F.sum("n").alias("all"), F.min("cid").alias("b"))
    met = signed.join(F.broadcast(sides), "up")
    return met.select("cid", (F.col("all") - F.col("n")).alias("links")), met.filter("cid <> b").select(F.col("cid").alias("a"), "b")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"  # floats are doubles in every product
    raw = pick(vectors, vec_id=F.col(f"`{id_col}`").cast("long"), v=F.col(f"`{vec_col}`").cast(kind))
    sound = F.expr("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = float('inf')) and exists(v, x -> x <> 0)")
    rows = materialize(spark, raw.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()), "vectors")
    usable = rows.filter("sound")
    classes = usable.groupBy("v").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n"))
    classes = materialize(spark, classes.select("cid", "n", "v", F.size("v").alias("d")), "vector-classes")
    counts = spark.createDataFrame([], "cid long, links long, d int")
    edges = spark.createDataFrame([], "a long, b long")
    for r in classes.groupBy("d").count().filter("count > 1").orderBy("d").collect():
        some = classes.filter(F.col("d") == r["d"]).select("cid", "n", "v")
        links, pairs = class_links(some, least) if r["d"] > 1 else sign_links(some)
        counts, edges = counts.unionByName(links.withColumn("d", F.lit(r["d"]))), edges.unionByName(pairs)
    groups = connected_components(edges)
    facts = classes.join(counts, ["cid", "d"], "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    facts = facts.select(F.col("v"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    joined = usable.join(facts, "v").select("vec_id", "n_links", "component_id")
    rest = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
