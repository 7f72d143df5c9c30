"""Scaling tile by tile: against dense sums, and what the plans move."""

import numpy as np
import pytest

from latticework.functions import kernels
from latticework.operators import resample
from latticework.operators.matrix import SparseMatrix


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def entries(rng, n, rows, cols):
    """Integers, with repeated cells, explicit zeros and cells that sum to zero."""
    out = [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, rows, n), rng.integers(0, cols, n), rng.integers(-3, 9, n), strict=True)]
    return [*out, *out[: n // 5], (rows - 1, cols - 1, 2.0), (0, 0, 5.0), (1, 1, 4.0), (1, 1, -4.0)]


def dense(found, rows, cols):
    out, stored = np.zeros((rows, cols)), np.zeros((rows, cols), bool)
    for r, c, v in found:
        out[r, c] += v
        stored[r, c] = True
    return out, stored


def lanczos_by_hand(found, n, m):
    """{(row, col): value} by whole matrices."""
    x, stored = dense(found, n, n)
    s, rho = m / n, kernels.lanczos_radius(m / n)
    w = np.zeros((m, n))
    for d in range(m):
        base = int(np.floor(d / s))
        for k in range(max(base - 2, 0), min(base + 4, n)):
            t = d / s - k
            w[d, k] = 1.0 if t == 0 else 0.0 if abs(t) >= 3 else np.sinc(t) * np.sinc(t / 3)
    w /= w.sum(axis=1)[:, None]
    near = lambda i: min(int(np.floor(i * s + 0.5)), m - 1)
    cand = {(near(r) + i, near(c) + j) for r, c in zip(*np.nonzero(stored), strict=True) for i in range(-rho, rho + 1) for j in range(-rho, rho + 1)}
    z = w @ x @ w.T
    return {(r, c): z[r, c] for r, c in sorted(cand) if 0 <= r < m and 0 <= c < m}


def alike(found, expected):
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - v) < 1e-9 for k, v in expected.items())


@pytest.fixture(params=[(7, 9), (256, 512)], ids=["small tiles", "one tile"])
def sizes(request, monkeypatch):
    """Tiles so small that all edges come up."""
    from latticework.operators import tiles

    monkeypatch.setattr(tiles, "SIDE", request.param[0])
    monkeypatch.setattr(tiles, "PART", request.param[1])


def cells(m):
    rows = [tuple(r) for r in m.df.select("row", "col", "value").collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {(r, c): v for r, c, v in rows}


@pytest.mark.parametrize(("n", "m"), [(31, 62), (31, 80), (40, 20), (40, 3), (5, 60), (33, 33)])
def test_lanczos_by_tiles(spark, sizes, n, m):
    found = entries(np.random.default_rng(n + m), 60, n, n)
    by_hand = {k: v for k, v in lanczos_by_hand(found, n, m).items() if abs(v) > 1e-10}
    alike(cells(SparseMatrix.from_entries(spark, found, n, n).scale("lanczos", m, m)), by_hand)


def test_lanczos_shuffles_entries_only(spark):
    """Sums of one axis and candidates are not shuffled, and nothing is joined: that took more than the time limit on 36 million entries."""
    m = SparseMatrix(spark.range(1000).selectExpr("id % 97 as row", "id % 89 as col", "1.0d as value"), 5000, 5000)
    text = plan(m.scale("lanczos", 10_000, 10_000).df)
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 2, text


@pytest.mark.parametrize(("n", "m", "cap"), [(31, 62, 40), (31, 62, 900), (40, 20, 25), (40, 7, 12), (5, 60, 70), (31, 62, 10**6)])
def test_capped_lanczos_by_hand(spark, n, m, cap):
    found = entries(np.random.default_rng(cap), 60, n, n)
    by_hand = dict(list(lanczos_by_hand(found, n, m).items())[:cap])
    alike(cells(SparseMatrix.from_entries(spark, found, n, n).scale("lanczos", m, m, candidate_cap=cap)), {k: v for k, v in by_hand.items() if abs(v) > 1e-10})


def test_a_cap_leaves_later_rows_out(spark):
    """Candidates are made of the rows that the first ones come from, not of all entries before they are cut."""
    m = SparseMatrix.from_entries(spark, [(k, k % 50, 1.0) for k in range(400)], 400, 400).merged()
    assert resample._first_rows(m, 800, 60).nnz() < 70


@pytest.mark.parametrize(("n", "m"), [((31, 20), (62, 80)), ((40, 40), (20, 9)), ((5, 7), (60, 7)), ((33, 12), (33, 50))])
def test_bilinear_by_tiles(spark, sizes, n, m):
    found = entries(np.random.default_rng(sum(n)), 90, *n)
    x, _ = dense(found, *n)
    axes = []
    for k in (0, 1):
        w, s = np.zeros((m[k], n[k])), m[k] / n[k]
        for d in range(m[k]):
            i0 = min(int(np.floor(d / s)), n[k] - 1)
            f = min(max(d / s - i0, 0.0), 1.0)
            w[d, i0] += 1 - f
            if i0 + 1 < n[k]:
                w[d, i0 + 1] += f
        axes.append(np.where(w > 1e-12, w, 0.0))
    z, reached = axes[0] @ x @ axes[1].T, ((axes[0] > 0).astype(int) @ (x != 0).astype(int) @ (axes[1] > 0).T.astype(int)) > 0
    alike(cells(SparseMatrix.from_entries(spark, found, *n).scale("bilinear", *m)), {(r, c): z[r, c] for r, c in zip(*np.nonzero(reached), strict=True)})


def big(spark, tmp_path, monkeypatch):
    """A matrix from files that count as many pieces."""
    from latticework.functions import pieces

    path = str(tmp_path / "entries")
    spark.range(3000).selectExpr("id * 37 % 2003 as row", "id * 91 % 2011 as col", "cast(id % 7 + 1 as double) as value").write.parquet(path)
    df = spark.read.parquet(path)
    monkeypatch.setattr(pieces, "PIECE_BYTES", pieces.source_bytes(df) // 20)
    return SparseMatrix(df, 2048, 2048)


def dealt_to(df):
    import re

    return [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", plan(df))]


def test_bilinear_tasks_follow_the_input(spark, tmp_path, monkeypatch):
    """The spread sums are not shuffled; entries go to as many tasks as their files are large, not to Spark's fixed number."""
    df = big(spark, tmp_path, monkeypatch).scale("bilinear", 4096, 8192).df
    assert plan(df).count("Exchange") == 2 and len(dealt_to(df)) == 2 and min(dealt_to(df)) >= 20, plan(df)


def test_bilinear_is_compared_in_one_pass(spark, tmp_path, monkeypatch):
    from latticework.operators import analysis

    m = big(spark, tmp_path, monkeypatch).merged()
    for compare in (analysis.detect_method, analysis.compare_scaling):
        text = plan(compare(m, m.scale("bilinear", 4096, 4096)))
        assert text.count("MapInArrow") == 1 and "REPARTITION_BY_NUM" in text, text
    up = m.scale("bilinear", 4096, 4096)
    r, x = analysis.compare_scaling(m, up).first(), cells(up)
    assert (r["after_nnz"], r["after_diag"]) == (len(x), sum(a == b and v != 0 for (a, b), v in x.items())) and abs(r["after_sum"] - sum(x.values())) < 1e-6


def test_lanczos_tasks_follow_the_input(spark, tmp_path, monkeypatch):
    df = big(spark, tmp_path, monkeypatch).scale("lanczos", 1024, 1024).df
    assert len(dealt_to(df)) == 2 and min(dealt_to(df)) >= 20, plan(df)


def test_features_of_many_cells(spark, tmp_path, monkeypatch):
    """A scaled matrix whose cells are apart already is not merged again, and mirror pairs go to tasks by the size of the files."""
    from latticework.operators import analysis

    m = big(spark, tmp_path, monkeypatch)
    up = m.scale("nearest", 4096, 4096)
    text = plan(analysis.features_square(up))
    assert text.count("REPARTITION_BY_NUM") == 5 and min(dealt_to(analysis.features_square(up))) >= 20, text  # four times the entries, once the pairs
    assert "least(row" not in "".join(x for x in text.splitlines() if "HashAggregate" in x)
    x = set(cells(m))
    x = {(2 * r + i, 2 * c + j) for r, c in x for i in (-1, 0) for j in (-1, 0) if 2 * r + i >= 0 and 2 * c + j >= 0}
    pairs, off = sum((c, r) in x for r, c in x if r < c), sum(r != c for r, c in x)
    found = analysis.features_square(up).first()
    assert found["nnz"] == len(x) and found["ndg"] == len({c - r for r, c in x}) and abs(found["psym"] - 2 * pairs / off) < 1e-12 and pairs > 0


def test_mirror_pairs_of_all_places(spark):
    """All places of a block and its neighbours, repeated cells, and a matrix with long indices."""
    from latticework.operators import analysis

    rng = np.random.default_rng(11)
    found = [(int(r), int(c), 1.0) for r, c in rng.integers(0, 33, (700, 2))]
    x = {(r, c) for r, c, _ in found}
    pairs, off = sum((c, r) in x for r, c in x if r < c), sum(r != c for r, c in x)
    m = SparseMatrix.from_entries(spark, found, 33, 33)
    for at, n in ((0, 33), (2**31 - 100, 2**31 - 1), (2**40, 2**41)):
        moved = SparseMatrix(m.df.selectExpr(f"row + {at}L as row", f"col + {at}L as col", "value"), n, n)
        assert abs(analysis.features_square(moved).first()["psym"] - 2 * pairs / off) < 1e-12


def _queries():
    from pyspark.sql import functions as F

    from latticework.operators import analysis, convert, validate

    return {
        "F12 stats_general": (lambda m: analysis.stats_general(m.merged()), 2),
        "F13 wavelet_identity": (lambda m: m.merged().scale("wavelet", 2048, 2048).df, 2),
        "F14 pattern_union": (lambda m: analysis.pattern_union(m.merged()), 2),
        "pattern_intersection": (lambda m: analysis.pattern_intersection(m.merged()), 3),
        "F15 value_asymmetry": (lambda m: analysis.value_asymmetry(m.merged()), 2),
        "F16 nearest_nonsquare": (lambda m: m.merged().scale("nearest", 4096, 8192).df, 1),
        "F17 compare_nonsquare": (lambda m: analysis.compare_scaling(m.merged(), m.merged().scale("nearest", 4096, 8192)), 2),
        "F19 csr_nested": (lambda m: convert.to_csr(m.merged()).select("row", F.col("cols").cast("string").alias("cols"), F.col("vals").cast("string").alias("vals")), 2),
        "csr of entries": (lambda m: convert.from_csr(convert.to_csr(m, dedup="sum"), 2048, 2048).df, 2),
        "row_ranks": (lambda m: convert.row_ranks(m.merged()), 2),
        "csr_violations": (lambda m: validate.csr_violations(m), 1),
        "merge_max": (lambda m: m.merged("max").df, 1),
    }


@pytest.mark.parametrize("name", list(_queries()))
def test_tasks_follow_the_input(spark, tmp_path, monkeypatch, name):
    """Many pieces are dealt to as many tasks, with the rows that few pieces give; merged cells are not merged again."""
    from latticework.functions import pieces

    make, shuffles = _queries()[name]
    m = big(spark, tmp_path, monkeypatch)
    m = SparseMatrix(m.df.union(m.df.filter("row % 3 = 0")), m.n_rows, m.n_cols)
    df = make(m)
    assert set(dealt_to(df)) and min(dealt_to(df)) >= 20, plan(df)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") >= shuffles
    many = sorted(map(tuple, df.collect()))
    monkeypatch.setattr(pieces, "PIECE_BYTES", 1 << 40)
    few = make(m)
    assert not dealt_to(few) and many == sorted(map(tuple, few.collect()))


def test_merged_cells_are_not_merged_again(spark):
    m = SparseMatrix.from_entries(spark, [(0, 0, 1.0), (0, 0, 2.0), (1, 1, 4.0)], 2, 2)
    once = m.merged()
    assert once.unique and plan(once.merged().df).count("HashAggregate") == plan(once.df).count("HashAggregate")
    assert not once.append(once).unique and cells(once.append(once).merged()) == {(0, 0): 6.0, (1, 1): 8.0}
    assert cells(once.transposed().without_zeros().merged("max")) == {(0, 0): 3.0, (1, 1): 4.0}
