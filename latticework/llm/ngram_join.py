"""N-gram Jaccard join: documents whose sets of five-word shingles link, and their components, exactly.

A join in the metric space of the sets. Regions are Voronoi cells of pivots; documents near an edge are replicated by windows
of the triangle inequality; regions are joined recursively. Two metrics serve: Jaccard distance to one-shingle pivots at the
top, where a general pivot would prune nothing (nearly all texts are at distance 1 of each other), and below that the symmetric
difference |A xor B|, which is at most (|A| + |B|) / 9 for a link at 80 percent, and is never less than the L1 distance of
the two sets' counts over classes of the shingle hash.

1. Copies: sets that are equal have one representative.
2. Top regions: the pivots are the one-shingle sets. A is at distance 1 - 1/|A| of its own shingles and at 1 of all others; of
   its nearest pivots the least one (frequent shingles last) is home. A partner may lack |A| - ceil(0.8 |A|) of them, so A is
   replicated to as many cells after its home: two sets that link meet in the cell of their least common shingle.
   The least id of a region stands for it: the others' distances to it are taken by classes, and verified links to it make
   the first components. Pairs of one component need no check from there on.
3. Recursion, for regions whose members are still apart. First, rings around the empty set, whose distance is the size: a set
   is at home in its ring and replicated to the next. Then cells: about PIVOTS members are pivots, a set within a ball of radius
   BALL (|A| + |P|) of its nearest pivot P is at home there, the others stay together for new pivots. A set visits another
   pivot's cell if a partner could be at home there: its distance is at most that of its nearest pivot plus twice a link's, and
   at most the ball's radius plus a link's. Links to the home pivot are verified and join components before the next round.
   Regions of BLOCK members or fewer, and those that pivots do not make smaller, are compared pair by pair under the windows.
4. Every pair that is left is verified on its words, not on hashes.

Frequent shingles are found by counts within tasks; their list is bounded (HEAVY_MOST) and steers the order only, never
the result. Their regions, and rows of large regions at all later steps, are salted.

Defined results: a null text counts as empty; a text without words has no shingles and links with nothing; a text with
fewer than five words has its whole sequence as one shingle; ids are whole numbers; rows that share an id are one node; a row with
a null id takes part as a copy only and, without an equal set that has an id, has a null component; an empty table gives an empty
result; other columns are not read. Sets are counted and found equal by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, bit_filter, by_bytes, discard, materialize, pick, probe, release_worker
from .components import connected_components

WORDS, PERCENT = 5, 80
#: A shingle counts as frequent from this many documents on, by the counts of tasks that saw it LOCAL times or more.
HEAVY, LOCAL, HEAVY_MOST = 24, 3, 1 << 18
#: Bits of the shingle hash that name a top region; regions that share a name by chance are one.
CELL_BITS = 48
#: Salts of a frequent shingle's region; members of a region that are compared pair by pair; members that share a salt.
SALTS, BLOCK, SALT_ROWS = 64, 256, 4096
#: Pivots of a region, on average, and the radius of their balls as a share of |A| + |P|.
PIVOTS, BALL = 16, 1 / 6
#: A round of pivots counts if no new region has more than this share of the old one, and all together no more than SPREAD times its rows.
SHRINK, SPREAD = 0.7, 3.0
#: Classes of a set: the power of two from a quarter of its size on, at least this many; a class counts to 15.
FEWEST = 256

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)  # a random number for each byte
    _VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
    _ORDER = _mixed(np.arange(300, 300 + WORDS + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[ord(b) for b in BLANKS]] = True
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


#: Bytes that are hashed at once.
CHUNK = 1 << 20


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(CHUNK, b), dtype=np.uint64)]) for b in (_BASE, _INVERSE))


def _word_sums(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and polynomial sum of each word among at most CHUNK bytes."""
    powers, back = _powers()
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[flat] * powers[: len(flat)], dtype=np.uint64)])
        edge = np.diff(np.concatenate([[True], _BLANK[flat], [True]]).astype(np.int8))
        begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        return begins, ends - begins, (sums[ends] - sums[begins]) * back[begins]


def _word_hashes(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(sums + lengths.astype(np.uint64) * _MIX)


def _long_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a long text, chunk by chunk; a word that a chunk's edge cuts is put together again."""
    sums, lengths, open_ = [], [], False
    for at in range(0, len(raw), CHUNK):
        flat = np.frombuffer(raw[at : at + CHUNK], np.uint8)
        b, n, s = _word_sums(flat)
        if open_ and len(b) and b[0] == 0:
            power = pow(int(_BASE), int(lengths[-1][-1]), 1 << 64)
            sums[-1][-1] = (int(sums[-1][-1]) + int(s[0]) * power) & (1 << 64) - 1
            lengths[-1][-1] += n[0]
            n, s = n[1:], s[1:]
        if len(n):
            sums.append(s.copy())
            lengths.append(n.copy())
        open_ = not _BLANK[flat[-1]]
    return _word_hashes(np.concatenate(sums), np.concatenate(lengths)) if sums else np.zeros(0, np.uint64)


def _shingled(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hash of the run of ``words`` words from each word on; fewer follow the last ones, whose values mean nothing."""
    rolled, k = np.zeros(len(hashes), np.uint64), len(hashes)
    with np.errstate(over="ignore"):
        for j in range(min(words, k)):
            rolled[: k - j] += hashes[j:] * _ORDER[j % len(_ORDER)]
        return _mixed(rolled)


def _one_set(hashes: np.ndarray, rolled: np.ndarray, words: int) -> np.ndarray:
    n = len(hashes)
    if n >= words:
        return np.unique(rolled[: n - words + 1])
    if not n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return _mixed(np.array([np.uint64(n) * _BASE + (hashes * _ORDER[:n]).sum(dtype=np.uint64)], np.uint64))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raws = [t.encode() for t in texts]
    if sum(map(len, raws)) + len(raws) > CHUNK:
        if len(raws) > 1:
            return [s for t in texts for s in shingle_sets([t], words)]
        hashes = _long_hashes(raws[0])
        return [_one_set(hashes, _shingled(hashes, words), words)]
    begins, lengths, sums = _word_sums(np.frombuffer(b" ".join(raws) + b" ", np.uint8))
    hashes = _word_hashes(sums, lengths)
    rolled = _shingled(hashes, words)
    first = np.searchsorted(begins, np.cumsum([0] + [len(r) + 1 for r in raws])).tolist()
    return [_one_set(hashes[a:b], rolled[a:b], words) for a, b in zip(first, first[1:], strict=False)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    release_worker()
    for batch in batches:
        for part in by_bytes(batch, "text", CHUNK - 20_000):
            yield part, shingle_sets([t or "" for t in part.column("text").to_pylist()])
    release_worker()


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, digest, classes) and, with hot set, the shingles that a stretch of rows repeats."""
    known, stretch, held = set(), [], 0
    names = ["doc_id", "n", "digest", "classes", "hot", "count"]

    def hot(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= LOCAL
        k = int(often.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names)

    for part, sets in _parts(batches):
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        k = len(sets)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _classes(sets), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)
        for s, d in zip(sets, digests, strict=True):
            if d is not None and d not in known:
                known.add(d)
                stretch.append(s)
                held += len(s)
        if held > 2_000_000:
            yield hot(stretch)
            known, stretch, held = set(), [], 0
    if stretch:
        yield hot(stretch)


def _level(n: int) -> int:
    return max(FEWEST, 1 << (max(n - 1, 0) // 4).bit_length())


def _classes(sets: list[np.ndarray]) -> pa.Array:
    """How many shingles of each class a set has, four bits a class, at the set's division and, unless that is the coarsest, at the one half as fine.

    Counts are cut at 15, which brings no two further apart, so the windows stay valid. Some 3 n / 16 to 3 n / 8 bytes, 128 at least.
    """
    out = []
    for s in sets:
        k = _level(len(s))
        counts = np.bincount((s >> np.uint64(20)).astype(np.int64) & k - 1, minlength=k)
        both = np.minimum(np.concatenate([counts, counts.reshape(2, -1).sum(0)]) if k > FEWEST else counts, 15).astype(np.uint8)
        out.append((both[::2] | both[1::2] << 4).tobytes() if len(s) else None)
    return pa.array(out, pa.binary())


def _levels(lengths: np.ndarray) -> np.ndarray:
    """The finer division of vectors of so many bytes."""
    return np.where(lengths == FEWEST // 2, FEWEST, lengths // 3 * 4)


def _divided(vectors: list[bytes], size: int) -> np.ndarray:
    """Counts of ``size`` classes as rows; each vector has that division as its finer or its coarser one."""
    half = size // 2
    flat = np.frombuffer(b"".join(v[:half] if len(v) <= 3 * half // 2 else v[size : size + half] for v in vectors), np.uint8).reshape(-1, half)
    return np.stack([flat & 15, flat >> 4], 2).reshape(-1, size).view(np.int8)


def _gaps(a: list[bytes], b: list[bytes], i: np.ndarray, j: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For pairs (a[i], b[j]): the L1 distance of their class counts at the division ``level`` that both have."""
    out = np.zeros(len(i), np.int64)
    for size in np.unique(level).tolist():
        some = np.flatnonzero(level == size)
        ua, ia = np.unique(i[some], return_inverse=True)
        ub, jb = np.unique(j[some], return_inverse=True)
        fa, fb = _divided([a[k] for k in ua], size), _divided([b[k] for k in ub], size)
        step = max(1, (1 << 21) // size)
        for at in range(0, len(some), step):
            part = slice(at, at + step)
            out[some[part]] = np.abs(fa[ia[part]] - fb[jb[part]]).sum(1, dtype=np.int64)
    return out


def _in_window(a: list[bytes], b: list[bytes], i: np.ndarray, j: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For pairs (a[i], b[j]) with |A| + |B| in sizes, whose sizes fit each other: |A xor B| <= (100 - p) / (100 + p) (|A| + |B|)
    for a link at p percent, and the gaps of the classes, at the coarser division of the two, sum to no more."""
    la, lb = np.array([len(v) for v in a], np.int64), np.array([len(v) for v in b], np.int64)
    return _gaps(a, b, i, j, _levels(np.minimum(la[i], lb[j]))) * (100 + PERCENT) <= (100 - PERCENT) * sizes


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links_seen (links found on the way; at least one if there is any)."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col)
    surveyed = materialize(spark, rows.mapInArrow(_survey, "doc_id long, n long, digest binary, classes binary, hot long, count long"), "sets")
    metas = surveyed.filter("hot is null").select("doc_id", "n", "digest")

    # 1. Copies.
    reps = materialize(spark, metas.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")), "set-reps")
    copies = metas.filter("n > 0").join(reps.filter("copies > 1").select("digest", "rep"), "digest").filter("doc_id is null or doc_id <> rep").select("doc_id")
    copies = materialize(spark, copies.filter("doc_id is not null").distinct(), "set-copies")

    # 2. Top regions, one member of each and the links to it.
    regions = _top_regions(rows, copies, surveyed)
    members = materialize(spark, regions.select("id").distinct(), "region-ids")
    held = surveyed.filter("hot is null and doc_id is not null and n > 0").select(F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), "digest", "classes")
    held = probe(held, bit_filter(members, "id"), "id").filter("hit").drop("hit").join(members, "id", "left_semi")
    vectors = materialize(spark, held.dropDuplicates(["id", "digest"]).drop("digest"), "classes")  # an id with several texts has all their vectors
    star = regions.filter("id <> pivot").filter(_sizes_fit("n", "pivot_n")).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    join = _Join(spark, rows)
    join.check(_near(star, vectors))

    # 3. Recursion where members other than the pivot are still apart.
    cells = regions.filter("id <> pivot").select(F.col("h").alias("cell"), "id", F.lit(True).alias("home"), F.lit(0).alias("level"), F.lit(False).alias("flat"))
    cells, whole = join.open(cells, vectors), True
    while cells is not None:
        direct = (F.col("members") <= BLOCK) | F.col("flat")
        pairs, large = join.compare(cells.filter(direct)), cells.filter(~direct)
        # Large regions are cut by size first, then by pivots round by round.
        split, near = (_rings(large), None) if whole else join.split(large)
        join.check(pairs if near is None else pairs.unionByName(near))
        discard(spark, cells, pairs)
        cells, whole = None if split is None else join.open(split, vectors), False

    # The result.
    final, every = join.groups, join.every()
    degree = every.select(F.col("a").alias("rep")).unionByName(every.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("seen"))
    facts = reps.select("digest", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    facts = facts.select("digest", F.coalesce("component", "rep").alias("component_id"), F.coalesce("seen", F.lit(0)).alias("n_links_seen"))
    out = metas.filter("n > 0").join(facts, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links_seen")
    empty = metas.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links_seen"))
    out = materialize(spark, out.unionByName(empty), "ngram-groups")
    discard(spark, regions, members, vectors, surveyed, reps, copies, *join.scratch)
    return out


def _top_regions(rows: DataFrame, copies: DataFrame, surveyed: DataFrame) -> DataFrame:
    """Rows (h, id, n, pivot, pivot_n): the members of each region, and the least id among them."""
    spark = rows.sparkSession
    heavies = surveyed.filter("hot is not null").groupBy("hot").agg(F.sum("count").alias("n")).filter(F.col("n") >= HEAVY)
    heavy = np.sort(np.array([r["hot"] for r in heavies.orderBy(F.desc("n"), "hot").limit(HEAVY_MOST).collect()], np.int64).view(np.uint64))
    heavy = spark.sparkContext.broadcast(heavy)  # at most HEAVY_MOST numbers: 2 MB

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _parts(batches):
            ids, sizes, cells, salted = part.column("doc_id").to_numpy(), [], [], []
            for s in sets:
                n = len(s)
                k = n - (-(-PERCENT * n // 100)) + 1 if n else 0
                spot = np.searchsorted(heavy.value, s)
                is_heavy = np.zeros(n, bool) if not len(heavy.value) else heavy.value[np.minimum(spot, len(heavy.value) - 1)] == s
                light = s[~is_heavy][:k]
                cells.append(np.concatenate([light, s[is_heavy][: k - len(light)]]))
                salted.append(np.arange(k) >= len(light))
                sizes.append((n, k))
            if not cells:
                continue
            n, k = np.array(sizes, np.int32).reshape(-1, 2).T
            flat, ids = np.concatenate(cells) & np.uint64((1 << CELL_BITS) - 1), np.repeat(ids, k)
            salt = np.where(np.concatenate(salted), 1 + ids % SALTS, 0)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(ids), pa.array(np.repeat(n, k))], ["h", "salt", "id", "n"])

    # Documents that are certainly no copies stay where they are; of the few others the copies go.
    known = probe(rows.filter("doc_id is not null"), bit_filter(copies, "doc_id"), "doc_id")
    known = known.filter("not hit").unionByName(known.filter("hit").join(copies, "doc_id", "left_anti")).drop("hit")
    entries = known.mapInArrow(prefixes, "h long, salt int, id long, n int")
    met = entries.repartition("h", "salt").sortWithinPartitions("h", "salt", "id")
    pairs = materialize(spark, met.mapInArrow(_runs, "h long, salt int, id long, n int"), "regions")
    # Regions with the same members (their number, and a sum and two xors of hashes of the ids) are one.
    marked = pairs.withColumn("k", F.xxhash64("id", F.lit(7))).withColumn("q", F.xxhash64("id", F.lit(8)))
    made = marked.groupBy("h").agg(F.min(F.struct("id", "n")).alias("pivot"), F.count(F.lit(1)).alias("members"), F.sum(F.shiftright("k", 32)).alias("sum"), F.bit_xor("k").alias("xor"), F.bit_xor("q").alias("xor2"))
    made = made.filter("members > 1").groupBy("pivot", "members", "sum", "xor", "xor2").agg(F.min("h").alias("h"))
    made = materialize(spark, made.select("h", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "regions-made")
    regions = materialize(spark, pairs.join(made, "h").select("h", "id", "n", "pivot", "pivot_n"), "regions")
    discard(spark, pairs, made)
    return regions


class _Join:
    """What the recursion has found: links, pairs that were checked, components."""

    def __init__(self, spark: SparkSession, rows: DataFrame):
        self.spark, self.rows = spark, rows
        self.links: list[DataFrame] = []
        self.checked: list[DataFrame] = []
        self.groups: DataFrame = spark.createDataFrame([], "node long, component long")
        self.scratch: list[DataFrame] = []

    def every(self) -> DataFrame:
        out = self.spark.createDataFrame([], "a long, b long")
        for links in self.links:
            out = out.unionByName(links)
        return out

    def check(self, pairs: DataFrame) -> None:
        """Verify pairs (a, b) that were not checked before, and renew the components."""
        pairs = pairs.distinct()
        for old in self.checked:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = materialize(self.spark, pairs, "pairs")
        self.checked.append(pairs)
        links = materialize(self.spark, _verified(pairs, self.rows), "links")
        self.scratch += [pairs, links]
        if links.take(1):
            self.links.append(links)
            # Components so far are stars; new links join them.
            stars = self.groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            self.groups = materialize(self.spark, connected_components(links.unionByName(stars)), "groups")
            self.scratch.append(self.groups)

    def open(self, cells: DataFrame, vectors: DataFrame) -> DataFrame | None:
        """Rows of the regions that have members at home and more than one component, with n, classes, component, homes and members."""
        named = cells.select("cell", "id", "home", "level", "flat").join(self.groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        state = named.groupBy("cell").agg((F.min("component") != F.max("component")).alias("open"), F.count(F.lit(1)).alias("members"), F.count_if("home").alias("homes"))
        state = materialize(self.spark, state.filter("open and homes > 0").drop("open"), "open")
        live = materialize(self.spark, named.join(state, "cell").join(vectors, "id"), "cells")
        discard(self.spark, cells, state)
        if not live.take(1):
            discard(self.spark, live)
            return None
        return live

    def compare(self, cells: DataFrame) -> DataFrame:
        """Pairs that the windows leave in regions that are compared block by block; at least one of a pair is at home."""
        row = F.struct("id", "n", "component", "classes", "home")
        pieces = F.ceil(F.col("members") / BLOCK)
        parted = cells.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("id", F.lit(2)), "pieces"))
        blocks = materialize(self.spark, parted.groupBy("cell", "pieces", "piece").agg(F.collect_list(row).alias("rows")), "blocks")
        # A block meets itself where it lies; only blocks of larger regions are joined.
        within = blocks.select(F.col("rows").alias("left_rows"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("right_rows"))
        left = blocks.filter("pieces > 1").select("cell", F.col("piece").alias("p"), F.col("rows").alias("left_rows"))
        right = blocks.filter("pieces > 1").select("cell", F.col("piece").alias("q"), F.col("rows").alias("right_rows"))
        across = left.join(right, "cell").filter("p < q").select("left_rows", "right_rows")
        pairs = within.mapInArrow(_windows, "a long, b long").unionByName(across.mapInArrow(_windows, "a long, b long")).distinct()
        pairs = materialize(self.spark, pairs, "windows")
        discard(self.spark, blocks)
        return pairs

    def split(self, cells: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """One round of pivots: the regions that come of it, and pairs of near members and their pivots. Regions that it does not make
        smaller stay as they are and are marked flat: the next round compares them block by block."""
        if not cells.take(1):
            return None, None
        order = F.xxhash64("id", "cell", F.lit(4))
        homes = cells.filter("home").withColumn("order", order)
        first = homes.groupBy("cell").agg(F.min(F.struct("order", "id"))["id"].alias("first"))
        chosen = homes.join(first, "cell").filter((F.col("id") == F.col("first")) | (F.pmod("order", "homes") < PIVOTS))
        salts = F.ceil(F.col("members") / SALT_ROWS).cast("long")
        pivots = chosen.groupBy("cell", "members").agg(F.collect_list(F.struct("id", "n", "classes")).alias("pivots"))  # some PIVOTS of a region
        pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("members")
        salted = cells.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(6)), salts))
        dealt = salted.join(pivots, ["cell", "salt"]).select("cell", "id", "n", "home", "level", "classes", "pivots")
        dealt = materialize(self.spark, dealt.mapInArrow(_deal, "parent long, pivot long, id long, home boolean, level int, near boolean"), "dealt")
        sizes = dealt.groupBy("parent", "pivot").agg(F.count(F.lit(1)).alias("n")).groupBy("parent").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
        before = cells.groupBy(F.col("cell").alias("parent")).agg(F.count(F.lit(1)).alias("members"))
        verdict = sizes.join(before, "parent").select("parent", ((F.col("most") <= SHRINK * F.col("members")) & (F.col("all") <= SPREAD * F.col("members"))).alias("smaller"))
        verdict = materialize(self.spark, verdict, "verdict")
        made = dealt.join(verdict.filter("smaller").select("parent"), "parent").select(F.xxhash64("parent", "pivot").alias("cell"), "id", "home", "level", F.lit(False).alias("flat"))
        same = cells.join(verdict.filter("not smaller").select(F.col("parent").alias("cell")), "cell", "left_semi").select("cell", "id", "home", "level", F.lit(True).alias("flat"))
        out = materialize(self.spark, made.unionByName(same), "cells")
        self.scratch += [dealt, verdict]
        return out, dealt.filter("near and id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))


def _rings(cells: DataFrame) -> DataFrame:
    """Regions by size: rings whose bounds grow by 100 / PERCENT, so a partner's ring is the same or a neighbour. ``level`` is a
    division of the classes that all sets of the ring and of the one before have."""
    ring = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / PERCENT)) + 1e-9)
    rings = cells.withColumn("ring", ring).withColumn("at", F.explode(F.array(F.col("ring"), F.col("ring") + 1)))
    least = F.pow(F.lit(100 / PERCENT), F.col("at") - 1) * 0.999 - 1
    level = F.greatest(F.lit(FEWEST), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(least / 4, F.lit(1.0)))))).cast("int")
    out = rings.select(F.xxhash64("cell", "at").alias("cell"), "id", (F.col("ring") == F.col("at")).alias("home"), level.alias("level"), F.lit(False).alias("flat"))
    return materialize(cells.sparkSession, out, "rings")


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a region with its pivots: its home, the cells that it visits, and whether it is near enough to link its pivot."""
    w = (100 - PERCENT) / (100 + PERCENT)
    reach = 100 / PERCENT  # a partner's size is at most this times one's own
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            lists = part.column("pivots")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            pid, pn = flat.field("id").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
            i, j = np.repeat(np.arange(part.num_rows), counts), np.arange(len(flat))
            n, level = part.column("n").to_numpy().astype(np.int64), part.column("level").to_numpy().astype(np.int64)
            gap = _gaps(part.column("classes").to_pylist(), flat.field("classes").to_pylist(), i, j, level[i])
            begins = np.cumsum(counts) - counts
            nearest = np.minimum.reduceat(gap, begins)
            first = np.full(part.num_rows, len(flat))
            np.minimum.at(first, i, np.where(gap == nearest[i], j, len(flat)))  # the first of the nearest pivots
            inside = gap[first] <= BALL * (n + pn[first])
            home = part.column("home").to_numpy(zero_copy_only=False)
            link = w * (1 + reach) * n  # no partner is further away than this
            visits = (gap <= nearest[i] + 2 * link[i]) & (gap <= BALL * (reach * n[i] + pn) + link[i])
            visits &= ~((j == first[i]) & inside[i] & home[i])
            k = np.flatnonzero(visits)
            rest = np.flatnonzero(~inside | ~home)  # the others' region: at home there if no ball holds them
            cell, ids = part.column("cell").to_numpy(), part.column("id").to_numpy()
            own = np.flatnonzero(inside & home)
            rows = np.concatenate([own, i[k], rest])
            pivot = np.concatenate([pid[first[own]], pid[k], np.full(len(rest), -1)])
            at_home = np.concatenate([np.ones(len(own), bool), np.zeros(len(k), bool), home[rest]])
            fits = np.concatenate([gap[first[own]] <= w * (n[own] + pn[first[own]]), np.zeros(len(k) + len(rest), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(cell[rows]), pa.array(pivot, pa.int64()), pa.array(ids[rows]), pa.array(at_home), pa.array(level[rows].astype(np.int32)), pa.array(fits)], ["parent", "pivot", "id", "home", "level", "near"])


def _sizes_fit(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, salt): those whose shingle another row shares, and all rows of salted shingles."""
    kept, given = None, False  # the last row, whose fate the next one tells, and whether it is out already
    for batch in batches:
        t = batch.select(["h", "salt", "id", "n"])
        if kept is not None:
            t = pa.Table.from_batches([kept, t]).combine_chunks().to_batches()[0]
        if t.num_rows == (kept is not None):
            continue
        h = t.column("h").to_numpy()
        keep = t.column("salt").to_numpy() > 0
        same = h[1:] == h[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        last = bool(keep[-1])
        if given:
            keep[0] = False
        yield t.filter(pa.array(keep))
        kept, given = t.slice(t.num_rows - 1, 1), last


def _near(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that the windows over the classes leave."""
    a = vectors.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("classes").alias("ac"))
    b = vectors.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("classes").alias("bc"))
    return pairs.join(b, "b").join(a, "a").mapInArrow(_window_pairs, "a long, b long")


def _window_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            sizes = part.column("an").to_numpy().astype(np.int64) + part.column("bn").to_numpy()
            every = np.arange(part.num_rows)
            yield part.select(["a", "b"]).filter(pa.array(_in_window(part.column("ac").to_pylist(), part.column("bc").to_pylist(), every, every, sizes)))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks, or of one where the other is null, that are in different components, one at home, and that the triangle inequality leaves."""
    for batch in batches:
        for left, right in zip(batch.column("left_rows"), batch.column("right_rows"), strict=True):
            alone = not right.is_valid
            ls = left.values
            rs = ls if alone else right.values
            li, ri = ls.field("id").to_numpy(), rs.field("id").to_numpy()
            ln, rn = ls.field("n").to_numpy().astype(np.int64), rs.field("n").to_numpy().astype(np.int64)
            apart = ls.field("component").to_numpy()[:, None] != rs.field("component").to_numpy()[None, :]
            apart &= ls.field("home").to_numpy(zero_copy_only=False)[:, None] | rs.field("home").to_numpy(zero_copy_only=False)[None, :]
            small, large = np.minimum(ln[:, None], rn), np.maximum(ln[:, None], rn)
            apart &= 100 * small >= PERCENT * large
            if alone:
                apart &= li[:, None] < ri
            i, j = np.nonzero(apart)
            if not len(i):
                continue
            fits = _in_window(ls.field("classes").to_pylist(), rs.field("classes").to_pylist(), i, j, ln[i] + rn[j])
            pairs = np.stack([li[i[fits]], ri[j[fits]]])
            low, high = pairs.min(0), pairs.max(0)
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])


def shingles(text: str, words: int = WORDS) -> set[tuple[bytes, ...]]:
    """The shingles themselves: of bytes, so only A-Z are lowered and only the six ASCII blanks split."""
    found = text.encode().lower().split()
    if len(found) < words:
        return {tuple(found)} if found else set()
    return set(zip(*(found[k:] for k in range(words)), strict=False))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that link, from rows (hub, salt, member, id, text) in order: a hub's own texts come before its members'."""
    release_worker()
    key, hubs = None, []
    for batch in batches:
        for part in by_bytes(batch, "text"):
            found: list[tuple[int, int]] = []
            for hub, salt, member, i, text in zip(*(part.column(c).to_pylist() for c in ("hub", "salt", "member", "id", "text")), strict=True):
                if key != (hub, salt):
                    key, hubs = (hub, salt), []
                x = shingles(text)
                if not member:
                    hubs.append(x)
                elif any(_link(x, y) for y in hubs):
                    found.append((hub, i))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])
    release_worker()


def _link(x: set, y: set) -> bool:
    if not x or not y or 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    common = len(x & y)
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link, by their words. Each text of a pair goes once to the pair's hub a; hubs of many pairs are salted."""
    spark = rows.sparkSession
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("long").alias("salts")).withColumnRenamed("a", "hub")
    counts = materialize(spark, counts, "hubs")
    members = pairs.join(counts, F.col("a") == F.col("hub")).select("hub", F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.lit(True).alias("member"), F.col("b").alias("id"))
    hubs = counts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("hub").alias("id"))
    wanted = materialize(spark, members.unionByName(hubs), "wanted")
    ids = materialize(spark, wanted.select("id").distinct(), "wanted-ids")
    found = probe(rows.filter("doc_id is not null and text is not null"), bit_filter(ids, "id"), "doc_id").filter("hit")  # and a few others, which the join drops
    met = wanted.join(found.select(F.col("doc_id").alias("id"), "text"), "id").select("hub", "salt", "member", "id", "text")
    met = met.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    out = materialize(spark, met.mapInArrow(_linked, "a long, b long").distinct(), "verified")
    discard(spark, counts, wanted, ids)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component (its least id), with the columns of ``docs``.

    Rows of other ids in a component go; they are picked by a fixed-size filter, so only texts of members move.
    """
    spark = docs.sparkSession
    groups = ngram_groups(docs, id_col, text_col)
    gone = materialize(spark, groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("lw_id")).distinct(), "near-gone")
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0))
    row = docs.select(key.alias("lw_key"), F.col(f"`{id_col}`").isNull().alias("lw_null"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("lw_row"))
    tested = probe(row, bit_filter(gone, "lw_id"), "lw_key")
    stays = tested.filter("not hit or lw_null").select("lw_row.*")
    checked = tested.filter("hit and not lw_null").join(gone, F.col("lw_key") == F.col("lw_id"), "left_anti").select("lw_row.*")
    return stays.unionByName(checked)
