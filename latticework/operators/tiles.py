"""Scaling by kernels of a few samples an axis, tile by tile.

A tile is a block of source cells; to it belong the results whose first sample (their base) lies in it. Entries go once to the tile of their cell,
and near an edge to its neighbours too: that shuffle of source entries is the only one, and no task holds more than a tile of them beside its sort.
Both axes are then summed in numpy over the rows and columns that have entries, so a tile with few entries costs little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.pieces import dealt

#: Rows and columns of a tile, and of the part of its result that is computed at once.
SIDE, PART = 256, 512
#: Rows of a batch that goes back to Spark, about.
BATCH = 1 << 17


class Axis:
    """Destinations of an axis, the samples of each and their weights."""

    def __init__(self, kind: str, n_src: int, n_dst: int):
        self.kind, self.n_src, self.n_dst, self.part = kind, n_src, n_dst, PART
        self.s = n_dst / n_src
        self.before, self.after = (2, 3) if kind == "lanczos" else (0, 1)  # samples around the base
        self.reach = kernels.lanczos_radius(self.s) if kind == "lanczos" else None  # of candidates around a place
        # Small scales have few results a tile: it has four at least. Large ones have many: a tile has no more than a part.
        self.side = max(1, min(SIDE, int(PART / self.s))) if self.s >= 1 else max(SIDE, -int(-4 // self.s))

    def place(self, c: Column) -> Column:
        return F.least(F.floor(c * F.lit(self.s) + 0.5), F.lit(self.n_dst - 1))

    def tiles(self, name: str) -> Column:
        """The tiles that an entry goes to."""
        c, last = F.col(name), F.lit((self.n_src - 1) // self.side)
        tile = lambda base: F.greatest(F.lit(0), F.least(F.floor(base / F.lit(self.side)), last))
        low, high = tile(c - self.after), tile(c + self.before)
        if self.reach is not None:
            base = lambda i: F.floor(i.cast("double") / F.lit(self.s))
            low = F.least(low, tile(base(self.place(c) - self.reach)))
            high = F.greatest(high, tile(base(self.place(c) + self.reach)))
        return F.explode(F.sequence(low.cast("long"), high.cast("long")))

    def base(self, d: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(d / self.s).astype(np.int64), self.n_src - 1)

    def destinations(self, tile: int) -> np.ndarray:
        low, high = int(tile * self.side * self.s) - 2, int((tile + 1) * self.side * self.s) + 2
        d = np.arange(max(low, 0), min(high, self.n_dst))
        return d[self.base(d) // self.side == tile]

    def samples(self, d: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Sources and weights, a column for each sample; one that does not count has the source -1."""
        y = d / self.s
        if self.kind == "lanczos":
            base = np.floor(y)
            offsets = np.arange(-2, 4)
            src = base[:, None].astype(np.int64) + offsets
            w = np.where((src >= 0) & (src < self.n_src), kernels.lanczos_weights_of((y - base)[:, None] - offsets), 0.0)
            return np.where((src >= 0) & (src < self.n_src), src, -1), w / w.sum(axis=1)[:, None]
        y0, y1 = np.minimum(np.floor(y), self.n_src - 1), np.minimum(np.ceil(y), self.n_src - 1)
        f = np.clip(y - y0, 0.0, 1.0)
        src, w = np.stack([y0, y1], 1).astype(np.int64), np.stack([1 - f, np.where(y1 == y0, 0.0, f)], 1)
        return np.where(w > least, src, -1), w


def _dilated(marks: np.ndarray, reach: int) -> np.ndarray:
    """Marks spread along the first axis."""
    out = marks.copy()
    for k in range(1, reach + 1):
        out[k:] |= marks[:-k]
        out[:-k] |= marks[k:]
    return out


def _candidates(a: np.ndarray, axis: Axis) -> tuple[np.ndarray, np.ndarray]:
    """Indices around the places of the sources, sorted, and where among them each source's place is."""
    near = np.minimum(np.floor(a * axis.s + 0.5).astype(np.int64), axis.n_dst - 1)
    places, which = np.unique(near, return_inverse=True)
    around = np.unique(places[:, None] + np.arange(-axis.reach, axis.reach + 1))  # whole windows, so neighbours in a window are neighbours here
    return around, np.searchsorted(around, places)[which]


def _known(found: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where in the sorted array each value is; past its end if it is nowhere."""
    at = np.searchsorted(found, wanted)
    return np.where((at < len(found)) & (found[np.minimum(at, len(found) - 1)] == wanted), at, len(found))


def _along(x: np.ndarray, at: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    """Weighted sums of rows of x, a row of ``at`` each; without weights whether any of them is set."""
    out = x[at[:, 0]] if w is None else x[at[:, 0]] * w[:, :1]
    for k in range(1, at.shape[1]):
        if w is None:
            out |= x[at[:, k]]
        else:
            out += x[at[:, k]] * w[:, k : k + 1]
    return out


def _tile(rt: int, ct: int, a: np.ndarray, b: np.ndarray, v: np.ndarray, rows: Axis, cols: Axis, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts (row, col, value) of one tile's result."""
    i, j = rows.destinations(rt), cols.destinations(ct)
    marks = None
    if rows.reach is not None:
        (ri, ra), (cj, ca) = _candidates(a, rows), _candidates(b, cols)
        marks = np.zeros((len(ri), len(cj)), bool)
        marks[ra, ca] = True
        marks = _dilated(np.ascontiguousarray(_dilated(marks, rows.reach).T), cols.reach).T
        here_i, here_j = np.isin(ri, i), np.isin(cj, j)
        i, j, marks = ri[here_i], cj[here_j], marks[here_i][:, here_j]
    stored = v != 0
    a, b, v = a[stored], b[stored], v[stored]
    if not len(a) or not len(i) or not len(j):
        return
    (ar, ai), (bc, bi) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
    x = np.zeros((len(ar) + 1, len(bc) + 1))  # the last row and column are those of sources without entries
    x[ai, bi] = v
    there = None
    if marks is None:
        there = np.zeros(x.shape, bool)
        there[ai, bi] = True
    touched = []
    for axis, d, found in ((rows, i, ar), (cols, j, bc)):
        src, w = axis.samples(d, least)
        at = _known(found, src)
        use = (at < len(found)).any(axis=1)
        touched.append((np.flatnonzero(use), at[use], w[use]))
    (ui, pi, wi), (uj, pj, wj) = touched
    for p in range(0, len(ui), rows.part):
        part = slice(p, p + rows.part)
        half = np.ascontiguousarray(_along(x, pi[part], wi[part]).T)
        any_half = None if there is None else np.ascontiguousarray(_along(there, pi[part], None).T)
        for q in range(0, len(uj), cols.part):
            qart = slice(q, q + cols.part)
            z = _along(half, pj[qart], wj[qart])
            if there is not None:
                keep = _along(any_half, pj[qart], None)
            else:
                keep = marks[np.ix_(ui[part], uj[qart])].T & ~(np.abs(z) <= 1e-10)
            k, h = np.nonzero(keep)
            if len(k):
                yield i[ui[part]][h], j[uj[qart]][k], z[k, h]


def scaled(cells: DataFrame, rows: Axis, cols: Axis, spread: float, least: float = 0.0) -> DataFrame:
    """(row, col, value) of the results of merged cells. A bilinear weight counts above ``least``. Of Lanczos results those on candidates are
    kept, cells around the scaled place of each stored cell (explicit zeros too), that are not 0 within 1e-10."""
    df = cells.select("row", "col", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    df = df.select("row", "col", "value", rows.tiles("row").alias("rt")).select("row", "col", "value", "rt", cols.tiles("col").alias("ct"))
    tiled = dealt(df, "rt", "ct", spread=spread)
    df = (df.repartition("rt", "ct") if tiled is df else tiled).sortWithinPartitions("rt", "ct")

    def work(batches):
        import pyarrow as pa

        out: list[tuple[np.ndarray, ...]] = []

        def whole(parts):
            """The results of all tiles in these sorted entries."""
            rt, ct, a, b, v = parts
            starts = np.concatenate([[0], np.flatnonzero((np.diff(rt) != 0) | (np.diff(ct) != 0)) + 1, [len(rt)]])
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                yield from _tile(int(rt[s]), int(ct[s]), a[s:e], b[s:e], v[s:e], rows, cols, least)

        def batch():
            arrays = [np.concatenate(x) for x in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["row", "col", "value"])

        def ready(parts):
            for part in whole(parts):
                out.append(part)
                if sum(len(x[0]) for x in out) >= BATCH:
                    yield batch()

        held: list[list[np.ndarray]] = []  # entries of the tile that goes on in the next batch
        for x in batches:
            if not x.num_rows:
                continue
            parts = [x.column(n).to_numpy(zero_copy_only=False) for n in ("rt", "ct", "row", "col", "value")]
            last = np.flatnonzero((parts[0] != parts[0][-1]) | (parts[1] != parts[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if held and (cut or (held[0][0][0], held[0][1][0]) != (parts[0][0], parts[1][0])):
                yield from ready([np.concatenate(p) for p in zip(*held, [y[:cut] for y in parts], strict=True)])
                held = []
            elif cut:
                yield from ready([y[:cut] for y in parts])
            held.append([y[cut:].copy() for y in parts])
        if held:
            yield from ready([np.concatenate(p) for p in zip(*held, strict=True)])
        if out:
            yield batch()

    return df.mapInArrow(work, "row long, col long, value double")
