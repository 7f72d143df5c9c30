import numpy as np
import pytest

from latticework.cli import main
from latticework.errors import FormatError, InvalidArgument, Unsupported
from latticework.functions import kernels
from latticework.functions.policies import register_policy
from latticework.operators import analysis, convert, validate
from latticework.operators.matrix import SparseMatrix
from latticework.sources.mtx import parse_header, read_mtx, register, write_mtx


def cells(m):
    return {(r["row"], r["col"]): r["value"] for r in m.df.select("row", "col", "value").collect()}


def dense(m):
    out = np.zeros((m.n_rows, m.n_cols))
    for (r, c), v in cells(m).items():
        out[r, c] += v
    return out


def vector(spark, n):
    return SparseMatrix.from_entries(spark, [(i, i, float(i + 1)) for i in range(n)], n, n)


@pytest.mark.parametrize(("n", "m", "blocks"), [(4, 4, {}), (4, 6, {1: [1], 3: [4]}), (4, 8, {0: [0], 1: [1, 2], 2: [3, 4], 3: [5, 6]}), (4, 12, {0: [0], 1: [2, 3], 2: [5, 6], 3: [8, 9]}), (8, 4, {})])
def test_nearest_blocks(spark, n, m, blocks):
    found = {}
    for r in kernels.nearest(spark.range(n).withColumnRenamed("id", "row"), "row", n, m, "dst").collect():
        found.setdefault(r["row"], []).append(r["dst"])
    assert {k: sorted(v) for k, v in found.items()} == blocks


@pytest.mark.parametrize(("n", "m"), [(4, 4), (4, 8), (8, 4), (9, 6), (7, 19)])
@pytest.mark.parametrize("precision", ["f32", "f64"])
def test_bilinear_weights(spark, n, m, precision):
    f = np.float32 if precision == "f32" else float
    expected = {}
    s = f(m) / f(n)
    for d in range(m):
        y = f(d) / s
        i0, i1 = min(int(np.floor(y)), n - 1), min(int(np.ceil(y)), n - 1)
        w = max(0.0, min(float(y - f(i0)), 1.0))
        for src, weight in {i1: w, i0: 1 - w}.items():
            if weight > 0:
                expected[src, d] = weight
    rows = kernels.bilinear(spark.range(n).withColumnRenamed("id", "row"), "row", n, m, "dst", "w", precision).collect()
    found = {(r["row"], r["dst"]): r["w"] for r in rows}
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-6 for k in found)


def test_transposing_and_scaling_commute(spark):
    rng = np.random.default_rng(3)
    m = SparseMatrix.from_entries(spark, [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 12, 30), rng.integers(0, 12, 30), rng.integers(1, 9, 30), strict=True)], 12, 12)
    for method in ("nearest", "bilinear", "lanczos"):
        assert np.allclose(dense(m.transposed().scale(method, 24, 24)), dense(m.scale(method, 24, 24)).T)


def test_fourier_matches_numpy_and_identity(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 16))
    m = SparseMatrix.from_entries(spark, [(i, j, x[i, j]) for i in range(20) for j in range(16)], 20, 16)
    assert np.allclose(dense(m.scale("fft", 20, 16, threshold=0.0)), x)
    whole = kernels.fourier_matrix(20, 30) @ x @ kernels.fourier_matrix(16, 32).T
    assert np.allclose(dense(m.scale("fft", 30, 32, threshold=0.0, batch_rows=None)), whole)
    batched = np.concatenate([kernels.fourier_matrix(8, 12) @ x[:8], kernels.fourier_matrix(8, 12) @ x[8:16], kernels.fourier_matrix(4, 6) @ x[16:]]) @ kernels.fourier_matrix(16, 32).T
    assert np.allclose(dense(m.scale("fft", 30, 32, threshold=0.0, batch_rows=8)), batched)
    limit, kernels.BROADCAST_ROWS = kernels.BROADCAST_ROWS, 1
    try:
        assert np.allclose(dense(m.scale("fft", 30, 32, threshold=0.0, batch_rows=8)), batched)
    finally:
        kernels.BROADCAST_ROWS = limit
    with pytest.raises(Unsupported):
        m.scale("fft", 5, 16)


def test_wavelet(spark):
    unit = SparseMatrix.from_entries(spark, [(0, 0, 1.0)], 4, 4)
    assert dense(unit.scale("wavelet", 8, 8))[0].tolist() == [1, 0, 0.75, -0.25, 0.25, 0.25, 0, 0]
    m = vector(spark, 8)
    assert cells(m.scale("wavelet", 8, 8)) == cells(m)
    for size in (12, 20, 4, 88):
        with pytest.raises(Unsupported):
            m.scale("wavelet", size, size)
    with pytest.raises(InvalidArgument):
        m.scale("wavelet", 16, 32)


def test_policies_and_builder(spark):
    b = SparseMatrix.builder(spark, 2, 2).add(0, 0, 1.0).add(0, 0, 3.0).add_batch([(1, 1, 2.0), (0, 0, 2.0)])
    assert b.added == 4
    for policy, value in {"sum": 6.0, "avg": 2.0, "max": 3.0, "min": 1.0, "last": 2.0}.items():
        assert cells(b.finalize(policy))[0, 0] == value
    with pytest.raises(InvalidArgument):
        b.finalize("median")
    from pyspark.sql import functions as F

    register_policy("count", lambda: F.count("value").cast("double"))
    assert cells(b.finalize("count"))[0, 0] == 3.0
    with pytest.raises(InvalidArgument):
        b.add(2, 0, 1.0)


def test_access_and_layouts(spark):
    m = SparseMatrix.from_entries(spark, [(0, 1, 5.0), (2, 0, 7.0), (2, 2, 0.0)], 4, 3)
    assert (m.get(0, 1), m.get(1, 1), m.has_entry(2, 2), m.has_entry(3, 0), m.row_nnz(2), m.nnz()) == (5.0, 0.0, True, False, 2, 3)
    assert convert.row_range(m, 2) == (1, 3)
    assert [(r["start"], r["end"]) for r in convert.row_ptr(m).orderBy("row").collect()] == [(0, 1), (1, 1), (1, 3), (3, 3)]
    assert cells(convert.from_csr(convert.to_csr(m), 4, 3)) == cells(m)
    with pytest.raises(InvalidArgument):
        convert.to_csr(m.append(m))
    with pytest.raises(InvalidArgument):
        m.get(4, 0)
    assert SparseMatrix.empty(spark, 3, 3).scale("bilinear", 6, 6).nnz() == 0
    assert validate.csr_violations(SparseMatrix.empty(spark, 3, 3)).first()["valid"]
    assert convert.row_stats(SparseMatrix.empty(spark, 3, 3)).first()["max_nnz"] == 0
    assert "density" in analysis.describe(m)


HEADER = "%%MatrixMarket matrix coordinate {} {}\n% note\n"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_reading(spark, tmp_path):
    plain = put(tmp_path / "a.mtx", HEADER.format("real", "general") + "4 4 3\n4 4 5\n1 2 1.5\n1 1 2\n9 9 9 ignored\n")
    assert cells(read_mtx(spark, plain)) == {(3, 3): 5.0, (0, 1): 1.5, (0, 0): 2.0}
    sym = put(tmp_path / "b.mtx", HEADER.format("pattern", "symmetric") + "3 3 2\n1 1\n3 1\n")
    assert cells(read_mtx(spark, sym)) == {(0, 0): 1.0, (2, 0): 1.0, (0, 2): 1.0}
    skew = put(tmp_path / "c.mtx", HEADER.format("integer", "skew-symmetric") + "3 3 1\n3 1 4\n")
    assert cells(read_mtx(spark, skew)) == {(2, 0): 4.0, (0, 2): -4.0}
    assert cells(read_mtx(spark, skew, strict_compat=True)) == {(2, 0): 4.0}
    register(spark)
    assert {tuple(r) for r in spark.read.format("mtx").option("splits", 3).load(sym).collect()} == {(0, 0, 1.0), (2, 0, 1.0), (0, 2, 1.0)}
    for k, text in enumerate(("1 1 2\n0 1 1\n1 1 1\n", "2 2 1\n3 1 1\n", "2 2 3\n1 1 1\n", "x y z\n")):
        with pytest.raises(FormatError):
            read_mtx(spark, put(tmp_path / f"bad{k}.mtx", HEADER.format("real", "general") + text))
    with pytest.raises(Unsupported):
        parse_header(["%%MatrixMarket matrix coordinate complex general", "1 1 1"])
    with pytest.raises(FormatError):
        parse_header(["%%MatrixMarket tensor coordinate real general", "1 1 1"])


def test_writing(spark, tmp_path):
    m = SparseMatrix.from_entries(spark, [(1, 0, 0.1), (0, 2, 1e-7), (0, 0, 3.0)], 2, 3)
    path = str(tmp_path / "out.mtx")
    write_mtx(m, path)
    lines = open(path).read().splitlines()
    assert lines[0] == "%%MatrixMarket matrix coordinate real general" and lines[2:] == ["2 3 3", "1 1 3.0", "1 3 1.0E-7", "2 1 0.1"]
    assert cells(read_mtx(spark, path)) == {k: float(np.float32(v)) for k, v in cells(m).items()}
    with pytest.raises(FormatError):
        write_mtx(m.append(m), path, compressed=True)
    with pytest.raises(FormatError):
        write_mtx(SparseMatrix.from_entries(spark, [(0, 0, float("inf"))], 1, 1), path)
    assert main(["-i", path, "-o", str(tmp_path / "up.mtx"), "-m", "bilinear", "-r", "4", "-c", "6", "-s"]) == 0
    assert cells(read_mtx(spark, str(tmp_path / "up.mtx"))).keys() == cells(m.scale("bilinear", 4, 6)).keys()


def test_stream(spark, tmp_path):
    from latticework.streaming.resample_stream import resample_stream

    m = vector(spark, 4)
    m.df.drop("seq").write.parquet(str(tmp_path / "in"))
    stream = resample_stream(spark.readStream.schema("row long, col long, value double").parquet(str(tmp_path / "in")), "bilinear", (4, 4), (8, 8))
    query = stream.writeStream.format("memory").queryName("scaled").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["row"], r["col"]): r["value"] for r in spark.table("scaled").collect()} == cells(m.scale("bilinear", 8, 8))


def test_the_order_of_entries_survives_appending(spark):
    first = SparseMatrix.from_entries(spark, [(0, 0, 1.0), (0, 0, 2.0), (0, 0, 3.0)], 2, 2)
    second = SparseMatrix.from_entries(spark, [(0, 0, 9.0)], 2, 2)
    assert cells(first.append(second).merged("last")) == {(0, 0): 9.0}
    assert cells(second.append(first).merged("last")) == {(0, 0): 3.0}
    frame = spark.createDataFrame([(0, 0, 5.0), (1, 1, 6.0)], "row long, col long, value double")
    assert cells(SparseMatrix.builder(spark, 2, 2).add(0, 0, 1.0).add_batch(frame).finalize("last")) == {(0, 0): 5.0, (1, 1): 6.0}
    assert cells(SparseMatrix.builder(spark, 2, 2).add_batch(frame).add(0, 0, 1.0).finalize("last")) == {(0, 0): 1.0, (1, 1): 6.0}
    assert cells(SparseMatrix.empty(spark, 2, 2).append(first).merged("last")) == {(0, 0): 3.0}
    assert SparseMatrix.builder(spark, 2, 2).finalize().nnz() == 0


def test_bilinear_has_no_noise_cells(spark):
    m = SparseMatrix.from_entries(spark, [(7, 3, 1.0), (2, 9, 4.0)], 14, 14)
    up, across = cells(m.scale("bilinear", 34, 34)), cells(m.transposed().scale("bilinear", 34, 34))
    assert {(c, r) for r, c in across} == set(up) and min(up.values()) > 1e-6
    assert all(abs(across[c, r] - v) < 1e-12 for (r, c), v in up.items())
    direct = cells(m.scale("bilinear", 34, 34, precision="f32"))
    assert all(abs(direct[k] - v) < 1e-5 for k, v in up.items())


@pytest.mark.parametrize(("shape", "label"), [((4, 2, 8, 4), "Upscale (Square 2.00x)"), ((4, 4, 8, 4), "Scale (Non-square 2.00x1.00)"), ((4, 4, 4, 4), "Identity (1x)"), ((8, 8, 2, 4), "Downscale (Non-square 0.25x0.50)")])
def test_scale_types(spark, shape, label):
    assert analysis.scale_type(SparseMatrix.empty(spark, *shape[:2]), SparseMatrix.empty(spark, *shape[2:])) == label


def test_empty_matrices_have_results(spark):
    none, one = SparseMatrix.empty(spark, 4, 4), SparseMatrix.from_entries(spark, [(0, 0, 2.0)], 8, 8)
    assert set(analysis.stats_general(none).first().asDict().values()) <= {0, 0.0, 1, 1.0, 4}
    assert None not in analysis.features_square(none).first()
    r = analysis.compare_scaling(none, one).first()
    assert (r["method"], r["nnz_ratio"], r["expected_nnz"], r["nnz_match"], r["sum_ratio"], r["value_conserved"]) == ("Unknown", float("inf"), 0.0, False, float("inf"), False)
    r = analysis.compare_scaling(none, none).first()
    assert (r["nnz_ratio"], r["nnz_match"], r["diag_match"], r["value_conserved"], r["density_ratio"]) == (0.0, True, True, True, 0.0)
    assert analysis.feature_comparison(none, none).count() == 14 and analysis.feature_bars(none, none).count() == 10
    assert "Unknown" in analysis.comparison_text(none, one) and "Upscale (Square 2.00x)" in analysis.comparison_text(none, one)


def test_feature_grades(spark):
    m = vector(spark, 8)
    rows = {r["feature"]: r for r in analysis.feature_comparison(m, m.scale("nearest", 16, 16)).collect()}
    assert abs(rows["nnz"]["expected"] - 8 * 2**1.2) < 1e-9 and abs(rows["dens"]["expected"] - 2**1.2 / 4 / 8) < 1e-12
    assert abs(rows["rmi"]["expected"] - 2**0.2) < 1e-9 and rows["profil"]["expected"] == 0.0 and rows["psym"]["grade"] == "GOOD"
    scored = [rows[f]["diff_pct"] * w for f, w in analysis.SCORED.items()]
    assert abs(analysis.feature_score(m, m.scale("nearest", 16, 16)).first()["score"] - sum(scored) / 6) < 1e-9


def test_source_counts_entries(spark, tmp_path):
    register(spark)
    load = lambda text, splits: spark.read.format("mtx").option("splits", splits).load(put(tmp_path / f"s{abs(hash(text))}.mtx", text))
    text = HEADER.format("real", "general") + "9 9 4\n" + "".join(f"{k} {k} {k}.5\n\n" for k in range(1, 8))
    for splits in (1, 3, 9):
        assert sorted((r["row"], r["value"]) for r in load(text, splits).collect()) == [(k - 1, k + 0.5) for k in range(1, 5)]
    with pytest.raises(Exception, match="announced"):
        load(HEADER.format("real", "general") + "9 9 4\n1 1 1\n2 2 2\n", 2).collect()
    many = "%%MatrixMarket matrix coordinate real general\n" + "% note\n" * 200 + "2 2 1\n2 2 3.5\n"
    assert cells(read_mtx(spark, put(tmp_path / "many.mtx", many))) == {(1, 1): 3.5}
