"""Structural statistics of a matrix, and comparisons of a scaled matrix with its source. All results are DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.pieces import dealt
from .matrix import SparseMatrix

#: Grades of the overall score, in percent. Fixed values of the result's definition.
EXCELLENT, GOOD, FAIR = 10.0, 20.0, 30.0
#: Entries are expected to grow with this power of the scale.
EXPONENT = 1.2
#: How a feature is expected to grow with the scale s (n: entries, n/s2: density, s, s2, n/s: entries of a row or column, 1: not at
#: all) and the difference in percent up to which it is good. Fixed values of the result's definition.
FEATURES = {
    "nnz": ("n", 15.0),
    "dens": ("n/s2", 20.0),
    "psym": ("1", 10.0),
    "diag": ("s", 25.0),
    "ndg": ("s", 25.0),
    "dist": ("1", 15.0),
    "band": ("s", 15.0),
    "profil": ("s2", 30.0),
    "rmx": ("n/s", 40.0),
    "rmi": ("n/s", 60.0),
    "rstd": ("n/s", 40.0),
    "cmx": ("n/s", 40.0),
    "cmi": ("n/s", 60.0),
    "cstd": ("n/s", 40.0),
}
#: Features of the overall score and their factors; the score is the mean over their number.
SCORED = {"psym": 1.0, "dist": 1.0, "band": 1.0, "nnz": 1.0, "diag": 1.0, "rstd": 0.5}
#: Features of the bar chart of ratios.
BARS = ("nnz", "dens", "psym", "band", "diag", "ndg", "rmx", "rstd", "cmx", "cstd")


def matrix_stats(m: SparseMatrix) -> DataFrame:
    """nnz, density, sparsity and moments of the stored values; the deviation is that of the population."""
    v, n = F.col("value"), F.count(F.lit(1))
    size = float(m.n_rows) * float(m.n_cols)
    return m.df.agg(n.alias("nnz"), (n / size).alias("density"), (1 - n / size).alias("sparsity"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.sum(v * v)).alias("frobenius"))


def pattern_intersection(m: SparseMatrix) -> DataFrame:
    """Cells of the matrix whose mirror cell is stored too."""
    p = m.df.select("row", "col")
    mirror = dealt(p.select(F.col("col").alias("row"), F.col("row").alias("col")), "row", "col", spread=m.spread)
    p = dealt(p, "row", "col", spread=m.spread)
    return (p if m.unique else p.distinct()).join(mirror, ["row", "col"], "left_semi")


def pattern_union(m: SparseMatrix) -> DataFrame:
    p = m.df.select("row", "col")
    return dealt(p.union(p.select("col", "row")), "row", "col", spread=m.spread).distinct()


def value_asymmetry(m: SparseMatrix) -> DataFrame:
    """Non-zero cells of the matrix less its mirror: one aggregation of the entries and their negated mirror images."""
    both = m.df.select("row", "col", "value").union(m.df.select("col", "row", -F.col("value")))
    return dealt(both, "row", "col", spread=m.spread).groupBy("row", "col").agg(F.sum("value").alias("value")).filter("value <> 0")


#: Columns of a pair of mirror cells: the lesser index and the greater.
PAIR = ("a", "b")


def _mirror_pairs(cells: DataFrame, m: SparseMatrix, *more: str) -> DataFrame:
    """The cells by the pair that they and their mirror cell are, dealt out to tasks by their size."""
    return dealt(cells.select(F.least("row", "col").alias("a"), F.greatest("row", "col").alias("b"), *more), *PAIR, spread=m.spread)


def stats_general(m: SparseMatrix) -> DataFrame:
    """Any shape; one row. sim: 1 if equal to its mirror; psym: Jaccard likeness of the pattern and its mirror; profile: per row the
    farthest entry from the diagonal, summed; rmx, rmi, mean, rstd, sum describe the values; dist is rstd / |mean|. Without entries
    all counts and values are 0, and a square pattern is its own mirror."""
    cells = m.merged().df
    size = float(m.n_rows) * float(m.n_cols)
    far = F.abs(F.col("col") - F.col("row"))
    zero = lambda c, z=0: F.coalesce(c, F.lit(z))
    per_row = cells.groupBy("row").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("row") == F.col("col")) & (F.col("value") != 0)).alias("diag"), F.max(far).alias("far"),
        F.max("value").alias("mx"), F.min("value").alias("mi"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"),
    )
    one = per_row.agg(
        zero(F.sum("n")).alias("nnz"), zero(F.sum("diag")).alias("diag"), zero(F.max("far")).alias("band"), zero(F.sum("far")).alias("profile"),
        zero(F.max("mx"), 0.0).alias("rmx"), zero(F.min("mi"), 0.0).alias("rmi"), zero(F.sum("s"), 0.0).alias("sum"), zero(F.sum("s2"), 0.0).alias("s2"),
    )
    if m.n_rows == m.n_cols:
        # Each unordered pair of mirror cells meets once: how many are stored, and whether they are equal.
        mirror = _mirror_pairs(cells, m, "value").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        off = F.col("a") != F.col("b")
        alike = mirror.agg(F.coalesce(F.sum(F.when(off & (F.col("n") == 2), 2).when(~off, 1).otherwise(0)), F.lit(0)).alias("both"), F.coalesce(F.sum(F.when(off, 2).otherwise(1)), F.lit(0)).alias("any"), F.coalesce(F.bool_and(~off | ((F.col("n") == 2) & (F.col("lo") == F.col("hi"))) | ((F.col("n") == 1) & (F.col("lo") == 0))), F.lit(True)).alias("same"))
        one = one.crossJoin(F.broadcast(alike))  # one row each
        sim, psym = F.col("same").cast("int"), F.when(F.col("any") > 0, F.col("both") / F.col("any")).otherwise(1.0)
    else:
        sim, psym = F.lit(0), F.lit(0.0)
    count = F.greatest(F.col("nnz"), F.lit(1))
    mean = F.col("sum") / count
    std = F.sqrt(F.greatest(F.col("s2") / count - mean * mean, F.lit(0.0)))
    return one.select(F.lit(m.n_rows).cast("long").alias("n"), "nnz", (F.col("nnz") / size).alias("density"), sim.alias("sim"), psym.alias("psym"), "diag", (F.col("nnz") - F.col("diag")).alias("ndg"), "band", "profile", "rmx", "rmi", mean.alias("mean"), std.alias("rstd"), "sum", F.when(F.abs(mean) > 1e-10, std / F.abs(mean)).otherwise(0.0).alias("dist"))


def _axis(per: DataFrame, size: int, prefix: str, *more) -> DataFrame:
    """Greatest, least (of those with entries) and deviation (of all, empty ones too) of the counts n of an axis."""
    n = F.col("n").cast("double")
    mean = F.sum(n) / float(size)
    spread = F.sqrt(F.greatest(F.sum(n * n) / float(size) - mean * mean, F.lit(0.0)))
    return per.agg(F.coalesce(F.max("n"), F.lit(0)).alias(f"{prefix}mx"), F.coalesce(F.min("n"), F.lit(0)).alias(f"{prefix}mi"), F.coalesce(spread, F.lit(0.0)).alias(f"{prefix}std"), *more)


def _mirror_count(m: SparseMatrix) -> DataFrame:
    """One row: the pairs of off-diagonal cells that mirror each other. Cells go in words to tasks by their size: a word is the pair of blocks of 8 x 8
    cells, the side and the place in the block; bits of either side are gathered in 64 of them. Repeated cells set the same bit."""
    off = m.df.filter("row <> col")
    if m.n_rows >= 1 << 31:
        mirror = _mirror_pairs(off.select("row", "col").distinct(), m).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("k"))
        return mirror.agg(F.count_if(F.col("k") == 2).alias("pairs"))
    off = off.select(F.least("row", "col").alias("a"), F.greatest("row", "col").alias("b"), (F.col("row") < F.col("col")).cast("long").alias("side"))
    word = F.expr(f"shiftleft(shiftright(a, 3) * {m.n_rows // 8 + 1}L + shiftright(b, 3), 7) + side * 64 + (a & 7) * 8 + (b & 7)")
    words = dealt(off.select(word.alias("word")), F.expr("shiftright(word, 7)"), spread=m.spread)
    bits = lambda side: F.expr(f"coalesce(bit_or(IF(word & 64 = {64 * side}, shiftleft(1L, CAST(word & 63 AS INT)), 0L)), 0L)")
    blocks = words.groupBy(F.expr("shiftright(word, 7)").alias("block")).agg(bits(0).alias("lower"), bits(1).alias("upper"))
    return blocks.agg(F.coalesce(F.sum(F.expr("bit_count(lower & upper)")), F.lit(0)).alias("pairs"))


def features_square(m: SparseMatrix) -> DataFrame:
    """Square matrices; one row. Here psym is the share of off-diagonal entries with a mirror entry, ndg the number of distinct
    diagonals, dist the mean distance from the diagonal over n, profil the sum over rows of the first entry's distance, and
    rmx, rmi, rstd, cmx, cmi, cstd describe entries per row and column. Without entries all are 0, and psym is 1.

    The merged cells are shuffled once; one aggregation each by row, column, diagonal and mirror pair follows.
    """
    if m.n_rows != m.n_cols:
        raise InvalidArgument("these features are those of square matrices")
    n, cells = m.n_rows, m.merged().df
    gap, count = F.abs(F.col("row") - F.col("col")), F.count(F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = cells.groupBy("row").agg(count.alias("n"), F.count_if(gap == 0).alias("on"), F.sum(gap).alias("gaps"), F.max(gap).alias("far"), F.abs(F.col("row") - F.min("col")).alias("lead"))
    one = _axis(rows, n, "r", total("n").alias("nnz"), total("on").alias("diag"), total("gaps").alias("gaps"), F.coalesce(F.max("far"), F.lit(0)).alias("band"), total("lead").alias("profil"))
    columns = _axis(cells.groupBy("col").agg(count.alias("n")), n, "c")
    diagonals = cells.select((F.col("col") - F.col("row")).alias("d")).distinct().agg(F.count(F.lit(1)).alias("ndg"))
    pairs = _mirror_count(m)
    for part in (columns, diagonals, pairs):
        one = one.crossJoin(F.broadcast(part))  # one row each
    psym = F.when(F.col("nnz") > F.col("diag"), 2 * F.col("pairs") / (F.col("nnz") - F.col("diag"))).otherwise(1.0)
    dist = F.col("gaps") / F.greatest(F.col("nnz"), F.lit(1)) / n
    return one.select(F.lit(n).cast("long").alias("n"), "nnz", (F.col("nnz") / (float(n) * n)).alias("dens"), psym.alias("psym"), "diag", "ndg", dist.alias("dist"), "band", "profil", "rmx", "rmi", "rstd", "cmx", "cmi", "cstd")


def scale_type(before: SparseMatrix, after: SparseMatrix) -> str:
    """Square means equal factors on both axes."""
    rs, cs = after.n_rows / before.n_rows, after.n_cols / before.n_cols
    if abs(rs - 1) < 1e-6 and abs(cs - 1) < 1e-6:
        return "Identity (1x)"
    shape = f"Square {rs:.2f}x" if abs(rs - cs) < 1e-6 else f"Non-square {rs:.2f}x{cs:.2f}"
    kind = "Upscale" if rs > 1 and cs > 1 else "Downscale" if rs < 1 and cs < 1 else "Scale"
    return f"{kind} ({shape})"


def _scaling_facts(m: SparseMatrix, prefix: str) -> DataFrame:
    """Entries, sum and diagonal cells that are not zero; one pass where a cell has one entry."""
    if m.unique:
        return m.df.agg(F.count(F.lit(1)).alias(f"{prefix}_nnz"), F.coalesce(F.sum("value"), F.lit(0.0)).alias(f"{prefix}_sum"), F.count_if((F.col("row") == F.col("col")) & (F.col("value") != 0)).alias(f"{prefix}_diag"))
    diagonal = m.df.filter("row = col").groupBy("row").agg(F.sum("value").alias("v")).agg(F.count_if(F.col("v") != 0).alias(f"{prefix}_diag"))
    return m.df.agg(F.count(F.lit(1)).alias(f"{prefix}_nnz"), F.coalesce(F.sum("value"), F.lit(0.0)).alias(f"{prefix}_sum")).crossJoin(F.broadcast(diagonal))  # one row each


def compare_scaling(before: SparseMatrix, after: SparseMatrix) -> DataFrame:
    """One row: scale factors, entries, diagonals and sums of both, what nearest scaling would give, and the method that the counts
    suggest. Ratios to a source of 0 are 0 if the result is 0 too, and infinite otherwise."""
    rs, cs = after.n_rows / before.n_rows, after.n_cols / before.n_cols
    one = _scaling_facts(before, "before").crossJoin(F.broadcast(_scaling_facts(after, "after")))  # one row each
    b_nnz, a_nnz, b_sum, a_sum, b_diag, a_diag = (F.col(f"{p}_{c}") for c in ("nnz", "sum", "diag") for p in ("before", "after"))
    infinite = F.lit(float("inf"))
    ratio = lambda a, b: F.when(b != 0, a / F.when(b != 0, b)).when(a == 0, 0.0).otherwise(infinite)
    expected = b_nnz * rs * cs
    expected_diag = b_diag * (rs if abs(rs - cs) < 1e-6 else min(rs, cs))
    sum_ratio = F.when(F.abs(b_sum) > 1e-10, a_sum / F.when(b_sum != 0, b_sum)).when(F.abs(a_sum) < 1e-10, 0.0).otherwise(infinite)
    conserved = F.when(F.abs(b_sum) > 1e-10, F.abs(sum_ratio - 1) < 1e-6).otherwise(F.abs(a_sum) < 1e-10)
    density = ratio(a_nnz / (float(after.n_rows) * after.n_cols), b_nnz / (float(before.n_rows) * before.n_cols))
    method = F.when(b_nnz == 0, "Unknown").when(F.abs(a_nnz - expected) < 1, "Nearest Neighbor").when(a_nnz > expected, "Bilinear (likely)").otherwise("Unknown")
    return one.select(
        F.lit(rs).alias("row_scale"), F.lit(cs).alias("col_scale"), F.lit(scale_type(before, after)).alias("scale_type"), "before_nnz", "after_nnz", ratio(a_nnz, b_nnz).alias("nnz_ratio"),
        expected.alias("expected_nnz"), (F.abs(a_nnz - expected) < 1).alias("nnz_match"), "before_diag", "after_diag", ratio(a_diag, b_diag).alias("diag_ratio"), expected_diag.cast("double").alias("expected_diag"),
        (F.abs(a_diag - expected_diag) < 1).alias("diag_match"), "before_sum", "after_sum", sum_ratio.alias("sum_ratio"), conserved.alias("value_conserved"), density.alias("density_ratio"), method.alias("method"),
    )


def detect_method(before: SparseMatrix, after: SparseMatrix) -> DataFrame:
    return compare_scaling(before, after).select("before_nnz", "after_nnz", "expected_nnz", "method")


def _growth(kind: str, scale: float, exponent: float) -> float:
    return {"1": 1.0, "n": scale**exponent, "n/s2": scale**exponent / scale**2, "s": scale, "s2": scale**2, "n/s": scale ** (exponent - 1)}[kind]


def _relative(value, expected):
    return F.when(expected != 0, F.abs(value - expected) / F.abs(F.when(expected != 0, expected)) * 100).when(value == 0, 0.0).otherwise(100.0)


def feature_comparison(before: SparseMatrix, after: SparseMatrix, exponent: float = EXPONENT) -> DataFrame:
    """A row per feature: both values, the expected one, the difference from it in percent, and a grade: GOOD below the feature's own
    threshold, OK below FAIR percent, else POOR. Least entries of a row or column are expected to be 1 at least; the diagonals
    cannot be more than the result has."""
    scale = after.n_rows / before.n_rows
    both = features_square(before).select(*[F.col(f).cast("double").alias(f"o_{f}") for f in FEATURES])
    both = both.crossJoin(F.broadcast(features_square(after).select(*[F.col(f).cast("double").alias(f"g_{f}") for f in FEATURES])))  # one row each
    rows = []
    for f, (kind, good) in FEATURES.items():
        expected = F.col(f"o_{f}") * F.lit(_growth(kind, scale, exponent))
        if f == "ndg":
            expected = F.least(expected, F.lit(2.0 * after.n_rows - 1))
        elif f in ("rmi", "cmi"):
            expected = F.greatest(F.lit(1.0), expected)
        rows.append(F.struct(F.lit(f).alias("feature"), F.col(f"o_{f}").alias("original"), F.col(f"g_{f}").alias("generated"), expected.alias("expected"), F.lit(good).alias("good")))
    out = both.select(F.inline(F.array(*rows))).withColumn("diff_pct", _relative(F.col("generated"), F.col("expected")))
    grade = F.when(F.col("diff_pct") < F.col("good"), "GOOD").when(F.col("diff_pct") < FAIR, "OK").otherwise("POOR")
    return out.withColumn("grade", grade).drop("good")


def feature_score(before: SparseMatrix, after: SparseMatrix, scored: dict[str, float] | None = None, exponent: float = EXPONENT) -> DataFrame:
    """One row: the mean of the scored features' differences, each times its factor, and its grade."""
    scored = scored or SCORED
    factor = F.lit(0.0)
    for name, w in scored.items():
        factor = F.when(F.col("feature") == name, float(w)).otherwise(factor)
    chosen = feature_comparison(before, after, exponent).filter(F.col("feature").isin(*scored))
    score = chosen.agg((F.sum(F.col("diff_pct") * factor) / float(len(scored))).alias("score"), F.count(F.lit(1)).alias("features"))
    return score.withColumn("grade", F.when(F.col("score") < EXCELLENT, "EXCELLENT").when(F.col("score") < GOOD, "GOOD").when(F.col("score") < FAIR, "OK").otherwise("POOR"))


def feature_bars(before: SparseMatrix, after: SparseMatrix, exponent: float = EXPONENT) -> DataFrame:
    """(feature, ratio, band): what a bar chart of generated over expected values draws; band is the colour class of the ratio.
    Where nothing is expected the ratio is 1."""
    scale = after.n_rows / before.n_rows
    compared = feature_comparison(before, after, exponent).filter(F.col("feature").isin(*BARS))
    plain = F.lit(1.0)  # without the bound on diagonals
    for f in BARS:
        plain = F.when(F.col("feature") == f, F.col("original") * F.lit(_growth(FEATURES[f][0], scale, exponent))).otherwise(plain)
    ratio = F.when(plain != 0, F.col("generated") / F.when(plain != 0, plain)).otherwise(1.0)
    off = F.abs(F.col("ratio") - 1)
    return compared.select("feature", ratio.alias("ratio")).withColumn("band", F.when(off < 0.1, "within 10%").when(off < 0.25, "within 25%").otherwise("beyond"))


def spy_points(matrices: dict[str, SparseMatrix], bins: int | None = None) -> DataFrame:
    """(name, y, x, count) of several matrices side by side: each entry's place, or with ``bins`` the cells of a raster."""
    out = None
    for name, m in matrices.items():
        points = density_heatmap(m, bins) if bins else m.df.select(F.col("row").alias("y"), F.col("col").alias("x"), F.lit(1).cast("long").alias("count"))
        points = points.select(F.lit(name).alias("name"), "y", "x", "count")
        out = points if out is None else out.unionByName(points)
    if out is None:
        raise InvalidArgument("no matrices to draw")
    return out


def density_heatmap(m: SparseMatrix, bins: int = 16) -> DataFrame:
    """(y, x, count) of the bins that hold entries: what a heat map or a scaled-down spy plot draws."""
    cell = lambda c, n: F.floor(F.col(c) * bins / F.lit(n)).cast("long")
    return m.df.groupBy(cell("row", m.n_rows).alias("y"), cell("col", m.n_cols).alias("x")).agg(F.count(F.lit(1)).alias("count"))


def feature_table(before: SparseMatrix, after: SparseMatrix) -> DataFrame:
    """(feature, original, generated, rel_diff_pct) of the size and all features, without expectations; the difference is absolute, 0 from 0."""
    values = lambda m, name: features_square(m).select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias(name)) for f in ("n", *FEATURES)])))
    both = values(before, "original").join(F.broadcast(values(after, "generated")), "feature")  # 15 rows
    diff = F.when(F.col("original") != 0, F.abs(F.col("generated") - F.col("original")) / F.abs(F.when(F.col("original") != 0, F.col("original"))) * 100).otherwise(0.0)
    return both.withColumn("rel_diff_pct", F.round(diff, 2))


def save_comparison_csv(before: SparseMatrix, after: SparseMatrix, path: str) -> None:
    """The feature table as CSV: Feature, Original, Generated, Rel_Diff_%."""
    order = F.array_position(F.array(*[F.lit(f) for f in ("n", *FEATURES)]), F.col("feature"))
    rows = feature_table(before, after).orderBy(order).toDF("Feature", "Original", "Generated", "Rel_Diff_%")
    rows.coalesce(1).write.option("header", True).csv(os.fspath(path))


#: Rows of the comparison text: column of stats_general, title, form.
_LINES = (
    ("nnz", "Non-zeros", "d"), ("density", "Density", "e"), ("sim", "Symmetric", "%"), ("psym", "Pattern symmetry", "%"), ("diag", "Diagonal entries", "d"), ("ndg", "Off-diagonal entries", "d"),
    ("band", "Bandwidth", "d"), ("profile", "Profile", "d"), ("rmx", "Greatest value", "g"), ("rmi", "Least value", "g"), ("mean", "Mean", "g"), ("rstd", "Deviation", "g"), ("dist", "Variation", "g"), ("sum", "Sum", "g"),
)


def comparison_text(before: SparseMatrix, after: SparseMatrix, method: str | None = None) -> str:
    """Both matrices' statistics side by side with ratios (differences for shares, and from 0), and what the scaling looks like."""
    x, y, scaling = (df.first() for df in (stats_general(before), stats_general(after), compare_scaling(before, after)))
    show = {"d": lambda v: f"{int(v):,}", "e": lambda v: f"{v:.4e}", "%": lambda v: f"{100 * v:.2f}%", "g": lambda v: f"{v:.6g}"}

    def change(a: float, b: float, form: str) -> str:
        if form == "%":
            return f"{100 * (b - a):+.2f}%"
        if form == "g" and abs(a) <= 1e-10:
            return f"{b - a:+.6g}"
        return f"{b / a:.4f}x" if a else "N/A"

    lines = [("", "original", "scaled", "change"), ("Method", "-", method or scaling["method"], "-")]
    lines.append(("Dimensions", f"{before.n_rows} x {before.n_cols}", f"{after.n_rows} x {after.n_cols}", f"{scaling['row_scale']:.2f}x, {scaling['col_scale']:.2f}x"))
    lines += [(title, show[form](x[c]), show[form](y[c]), change(x[c], y[c], form)) for c, title, form in _LINES]
    table = "\n".join(" | ".join(f"{cell:<22}" for cell in line).rstrip() for line in lines)
    facts = f"{scaling['scale_type']}: entries {scaling['nnz_ratio']:.4f}x (nearest would give {scaling['expected_nnz']:.4f}), sum {scaling['sum_ratio']:.6f}x, values {'conserved' if scaling['value_conserved'] else 'not conserved'}"
    return f"{table}\n{facts}"


def describe(m: SparseMatrix) -> str:
    """A short text: shape, entries, density and sparsity, each under its own name."""
    s = matrix_stats(m).first()
    return f"{m.n_rows} x {m.n_cols}, {s['nnz']} entries, density {s['density']:.6g}, sparsity {s['sparsity']:.6g}, sum {s['sum'] or 0:.6g}, norm {s['frobenius'] or 0:.6g}"
