"""The registered queries, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import kernels
from ..operators import analysis, convert, resample, validate
from ..operators.matrix import SparseMatrix
from ..sources.mtx import expand_symmetric, put_text, read_csr, read_mtx, write_mtx
from ..sources.mtx import register as register_mtx
from ..streaming.resample_stream import resample_stream

# ---- Base matrices (row, col, value, and seq where the order matters) ----


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster shares; a temporary one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidArgument("spark.checkpoint.dir names no folder that the cluster shares")
        base = f"{tempfile.gettempdir()}/latticework-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}-{name}"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def m_dup(spark: SparkSession, d: str) -> SparseMatrix:
    """lineitem by part and supplier modulo 64, quantities as values; many entries a cell."""
    df = _read(spark, d, "lineitem").select((F.col("l_partkey") % 64).alias("row"), (F.col("l_suppkey") % 64).alias("col"), F.col("l_quantity").alias("value"))
    return SparseMatrix(df, 64, 64)


def m_sum(spark: SparkSession, d: str) -> SparseMatrix:
    return m_dup(spark, d).merged()


#: Sides of the matrices below, of all rows of lineitem: wide enough to be sparse (0.2% of the cells at sf0.1).
SIDE, NARROW = 1 << 14, 1 << 13
TWICE = 2 * SIDE


def m_sparse(spark: SparkSession, d: str) -> SparseMatrix:
    """All of lineitem by order and part."""
    df = _read(spark, d, "lineitem").select((F.col("l_orderkey") % SIDE).alias("row"), (F.col("l_partkey") % NARROW).alias("col"), F.col("l_quantity").alias("value"))
    return SparseMatrix(df, SIDE, NARROW).merged()


def m_events(spark: SparkSession, d: str) -> SparseMatrix:
    """events by user and event modulo 64; the event id is the order of the entries."""
    df = _read(spark, d, "events").select(F.col("user_id").alias("row"), (F.col("event_id") % 64).alias("col"), "value", F.col("event_id").alias("seq"))
    return SparseMatrix(df, 1 << 40, 64)


def m_vectors(spark: SparkSession, d: str) -> SparseMatrix:
    df = _read(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("pos", "x"))
    return SparseMatrix(df.select("row", F.col("pos").cast("long").alias("col"), F.col("x").cast("double").alias("value")), 1 << 40, 64)


def m_zeros(spark: SparkSession, d: str) -> SparseMatrix:
    """The summed matrix with explicit zeros on every fifth antidiagonal."""
    m = m_sum(spark, d)
    return m.with_df(m.df.withColumn("value", F.when((F.col("row") + F.col("col")) % 5 == 0, 0.0).otherwise(F.col("value"))))


def m_binary(spark: SparkSession, d: str) -> SparseMatrix:
    m = m_sparse(spark, d)
    return m.with_df(m.df.withColumn("value", F.lit(1.0)))


def m_square(spark: SparkSession, d: str) -> SparseMatrix:
    """All of lineitem by part and order; a square matrix with entries on and off the diagonal."""
    df = _read(spark, d, "lineitem").select((F.col("l_partkey") % SIDE).alias("row"), (F.col("l_orderkey") % SIDE).alias("col"), F.col("l_quantity").alias("value"))
    return SparseMatrix(df, SIDE, SIDE).merged()


def m_folded(spark: SparkSession, d: str, side: int = 96) -> SparseMatrix:
    """All of lineitem folded to a small square, for results that are dense whatever the input."""
    df = _read(spark, d, "lineitem").select((F.col("l_partkey") % side).alias("row"), (F.col("l_orderkey") % side).alias("col"), F.col("l_quantity").alias("value"))
    return SparseMatrix(df, side, side).merged()


def m_none(spark: SparkSession) -> SparseMatrix:
    return SparseMatrix.empty(spark, 256, 256)


_DUP = "SELECT l_partkey % 64 AS r, l_suppkey % 64 AS c, l_quantity AS v FROM lineitem"
_SUM = f"SELECT r, c, sum(v) AS v FROM ({_DUP}) GROUP BY r, c"
_SPARSE = f"SELECT l_orderkey % {SIDE} AS r, l_partkey % {NARROW} AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
_EVENTS = "SELECT user_id AS r, event_id % 64 AS c, value AS v, event_id AS seq FROM events"
_VECTORS = "SELECT vec_id AS r, unnest(range(0, len(embedding))) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings"
_ZEROS = f"SELECT r, c, CASE WHEN (r + c) % 5 = 0 THEN 0.0 ELSE v END AS v FROM ({_SUM})"
_SQUARE = f"SELECT l_partkey % {SIDE} AS r, l_orderkey % {SIDE} AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
_FOLDED = lambda side: f"SELECT l_partkey % {side} AS r, l_orderkey % {side} AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"
_NONE = "SELECT 0::BIGINT AS r, 0::BIGINT AS c, 0.0::DOUBLE AS v WHERE false"
_OUT = 'r AS "row", c AS col, v AS "value"'


def _entries(m: SparseMatrix, digits: int | None = None) -> DataFrame:
    value = F.col("value").cast("double")
    return m.df.select("row", "col", (F.round(value, digits) + F.lit(0.0) if digits is not None else value).alias("value"))


# ---- SQL of the kernels ----


def _nearest_sql(base: str, n: tuple[int, int], m: tuple[int, int], agg: str = "sum(v)") -> str:
    axis = lambda k: f"SELECT s, unnest(range(greatest(least(ceil((s - 0.5) * {m[k] / n[k]!r}), {m[k]}), 0)::BIGINT, greatest(least(floor((s + 0.5) * {m[k] / n[k]!r}), {m[k]}), 0)::BIGINT)) AS d FROM (SELECT unnest(range(0, {n[k]})) AS s)"
    return f'WITH m AS ({base}), kr AS ({axis(0)}), kc AS ({axis(1)}) SELECT kr.d AS "row", kc.d AS col, ({agg})::DOUBLE AS "value" FROM m JOIN kr ON kr.s = m.r JOIN kc ON kc.s = m.c WHERE m.v <> 0 GROUP BY 1, 2'


def _bilinear_sql(base: str, n: tuple[int, int], m: tuple[int, int]) -> str:
    def axis(k: int) -> str:
        y = f"SELECT d, least(floor(d / {m[k] / n[k]!r}), {n[k] - 1})::BIGINT AS i0, greatest(least(d / {m[k] / n[k]!r} - least(floor(d / {m[k] / n[k]!r}), {n[k] - 1}), 1.0), 0.0) AS f FROM (SELECT unnest(range(0, {m[k]})) AS d)"
        return f"SELECT i0 AS s, d, 1 - f AS w FROM ({y}) WHERE f < 1 UNION ALL SELECT i0 + 1, d, f FROM ({y}) WHERE f > 0 AND i0 + 1 < {n[k]}"

    return f'WITH m AS ({base}), kr AS ({axis(0)}), kc AS ({axis(1)}) SELECT kr.d AS "row", kc.d AS col, sum(m.v * kr.w * kc.w)::DOUBLE AS "value" FROM m JOIN kr ON kr.s = m.r JOIN kc ON kc.s = m.c WHERE m.v <> 0 AND kr.w * kc.w > 1e-12 GROUP BY 1, 2'


def _lanczos_sql(base: str, n: int, m: int, cap: int | None = None) -> str:
    s, rho = m / n, kernels.lanczos_radius(m / n)
    return f"""
        WITH m AS ({base}),
        p AS (SELECT d, floor(d / {s!r})::BIGINT + o AS s, d / {s!r} - floor(d / {s!r}) - o AS x FROM (SELECT unnest(range(0, {m})) AS d), (SELECT unnest(range(-2, 4)) AS o)),
        k AS (SELECT d, s, CASE WHEN x = 0 THEN 1.0 WHEN abs(x) >= 3 THEN 0.0 ELSE 3 * sin(pi() * x) * sin(pi() * x / 3) / (pi() * x * pi() * x) END AS w FROM p WHERE s >= 0 AND s < {n}),
        t AS (SELECT d, sum(w) AS tot FROM k GROUP BY d),
        q AS (SELECT DISTINCT least(floor(r * {s!r} + 0.5), {m - 1})::BIGINT AS r, least(floor(c * {s!r} + 0.5), {m - 1})::BIGINT AS c FROM m),
        cand AS (SELECT DISTINCT r + i AS r, c + j AS c FROM q, (SELECT unnest(range({-rho}, {rho + 1})) AS i), (SELECT unnest(range({-rho}, {rho + 1})) AS j) WHERE r + i BETWEEN 0 AND {m - 1} AND c + j BETWEEN 0 AND {m - 1}{f' ORDER BY 1, 2 LIMIT {cap}' if cap else ''}),
        o AS (SELECT a.d AS r, b.d AS c, sum(m.v * a.w * b.w) / (any_value(ta.tot) * any_value(tb.tot)) AS v FROM m JOIN k a ON a.s = m.r JOIN k b ON b.s = m.c JOIN t ta ON ta.d = a.d JOIN t tb ON tb.d = b.d SEMI JOIN cand ON cand.r = a.d AND cand.c = b.d GROUP BY 1, 2)
        SELECT r AS "row", c AS col, round(v, 8) + 0.0 AS "value" FROM o WHERE abs(v) > 1e-10"""


def _fft_sql(base: str, n: tuple[int, int], m: tuple[int, int], threshold: float) -> str:
    def axis(k: int) -> str:
        a, b = n[k], m[k]
        low, high = (a + 1) // 2, a // 2
        terms = f"SELECT t, CASE WHEN t >= {b - high} THEN {a} - ({b} - t) ELSE t END AS b FROM (SELECT unnest(range(0, {b})) AS t) WHERE t >= {b - high} OR t < {low}"
        return f"SELECT j AS d, i AS s, sum(cos(2 * pi() * (t * j / {float(b)!r} - b * i / {float(a)!r}))) / {float(a)!r} AS w FROM ({terms}), (SELECT unnest(range(0, {b})) AS j), (SELECT unnest(range(0, {a})) AS i) GROUP BY 1, 2"

    return f"""
        WITH m AS ({base}), kr AS ({axis(0)}), kc AS ({axis(1)}),
        h AS (SELECT m.r, kc.d AS c, sum(m.v * kc.w) AS v FROM m JOIN kc ON kc.s = m.c GROUP BY 1, 2),
        o AS (SELECT kr.d AS r, h.c, sum(h.v * kr.w) AS v FROM h JOIN kr ON kr.s = h.r GROUP BY 1, 2)
        SELECT r AS "row", c AS col, round(v, 6) + 0.0 AS "value" FROM o WHERE abs(v) >= {threshold!r}"""


def _wavelet_sql(base: str, n: int, m: int) -> str:
    """Haar by sums: a tile's transform has its mean (0, 0), the halves' differences (0, 1), (1, 0), (1, 1) and the quarters' ones; the
    new tile takes the coefficient at floor(k / s), and is summed back by signs."""
    s, size = m / n, int(4 * m / n)
    # Coefficient k of an axis of 4: 0 mean of all, 1 half difference of the halves, 2 and 3 differences inside the halves. In two dimensions the second
    # level acts on the quarter of first-level means only, so coefficients outside it come from one level.
    one = "SELECT k, x, CASE WHEN k < 2 THEN CASE WHEN x // 2 = k THEN 0.5 ELSE 0.0 END ELSE CASE WHEN x // 2 = k - 2 THEN 0.5 * CASE WHEN x % 2 = 0 THEN 1 ELSE -1 END ELSE 0.0 END END AS w FROM (SELECT unnest(range(0, 4)) AS k), (SELECT unnest(range(0, 4)) AS x)"
    two = "SELECT k, x, 0.5 * CASE WHEN k = 1 AND x = 1 THEN -1 ELSE 1 END AS w FROM (SELECT unnest(range(0, 2)) AS k), (SELECT unnest(range(0, 2)) AS x)"
    half, quarter = size // 2, size // 4
    back = f"SELECT k, x, CASE WHEN k < {half} THEN CASE WHEN x // 2 = k THEN 1 ELSE 0 END ELSE CASE WHEN x // 2 = k - {half} THEN CASE WHEN x % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END END AS w FROM (SELECT unnest(range(0, {size})) AS k), (SELECT unnest(range(0, {size})) AS x)"
    inner = f"SELECT k, x, CASE WHEN k < {quarter} THEN CASE WHEN x // 2 = k THEN 1 ELSE 0 END ELSE CASE WHEN x // 2 = k - {quarter} THEN CASE WHEN x % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END END AS w FROM (SELECT unnest(range(0, {half})) AS k), (SELECT unnest(range(0, {half})) AS x)"
    return f"""
        WITH m AS ({base}), one AS ({one}), two AS ({two}), back AS ({back}), inn AS ({inner}),
        l1 AS (SELECT r // 4 AS tr, c // 4 AS tc, a.k AS i, b.k AS j, sum(v * a.w * b.w) AS v FROM m JOIN one a ON a.x = r % 4 JOIN one b ON b.x = c % 4 GROUP BY 1, 2, 3, 4),
        l2 AS (SELECT tr, tc, a.k AS i, b.k AS j, sum(v * a.w * b.w) AS v FROM l1 JOIN two a ON a.x = i JOIN two b ON b.x = j WHERE i < 2 AND j < 2 GROUP BY 1, 2, 3, 4
            UNION ALL SELECT * FROM l1 WHERE i >= 2 OR j >= 2),
        z AS (SELECT tr, tc, p.k AS i, q.k AS j, v FROM l2 JOIN (SELECT unnest(range(0, {size})) AS k) p ON least(floor(p.k / {s!r}), 3) = i JOIN (SELECT unnest(range(0, {size})) AS k) q ON least(floor(q.k / {s!r}), 3) = j),
        b2 AS (SELECT tr, tc, a.x AS i, b.x AS j, sum(v * a.w * b.w) AS v FROM z JOIN inn a ON a.k = i JOIN inn b ON b.k = j WHERE i < {half} AND j < {half} GROUP BY 1, 2, 3, 4
            UNION ALL SELECT * FROM z WHERE i >= {half} OR j >= {half}),
        b1 AS (SELECT tr, tc, a.x AS i, b.x AS j, sum(v * a.w * b.w)::DOUBLE AS v FROM b2 JOIN back a ON a.k = i JOIN back b ON b.k = j GROUP BY 1, 2, 3, 4),
        o AS (SELECT floor(4 * tr * {s!r})::BIGINT + i AS r, floor(4 * tc * {s!r})::BIGINT + j AS c, v FROM b1 WHERE abs(v) > 1e-5)
        SELECT {_OUT} FROM o WHERE r < {m} AND c < {m}"""


_Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _merge(policy: str, make: Callable, keep: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _entries(make(s, d).merged(policy), keep)


# ---- Scans, projections, filters, access ----
_Q["coo_scan"] = (lambda s, d: _entries(m_vectors(s, d)), f"SELECT {_OUT} FROM ({_VECTORS})")
_Q["coo_sorted_rows"] = (lambda s, d: _entries(m_sum(s, d).sorted()), f"SELECT {_OUT} FROM ({_SUM}) ORDER BY r, c")
_Q["coo_rebased"] = (lambda s, d: m_sum(s, d).df.select((F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"), F.greatest(F.lit(0.0), F.least("value", F.lit(500.0))).alias("value")), f'SELECT r + 1 AS "row", c + 1 AS col, greatest(0.0, least(v, 500.0)) AS "value" FROM ({_SUM})')
_Q["tile_keys"] = (lambda s, d: m_sparse(s, d).df.select(F.expr(f"(row div 4) * {NARROW // 4} + col div 4").alias("tile"), "row").groupBy("tile").agg(F.count(F.lit(1)).alias("nnz")), f"SELECT (r // 4) * {NARROW // 4} + c // 4 AS tile, count(*) AS nnz FROM ({_SPARSE}) GROUP BY 1")
_Q["coo_zero_skip"] = (lambda s, d: _entries(m_zeros(s, d).without_zeros()), f"SELECT {_OUT} FROM ({_ZEROS}) WHERE v <> 0")
_Q["coo_threshold_filter"] = (lambda s, d: _entries(m_vectors(s, d).above(0.2)), f"SELECT {_OUT} FROM ({_VECTORS}) WHERE abs(v) > 0.2")
_Q["point_get"] = (lambda s, d: m_sum(s, d).cell(5, 7).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"), (F.count(F.lit(1)) > 0).alias("found")), f'SELECT coalesce(max(v), 0.0) AS "value", count(*) > 0 AS found FROM ({_SUM}) WHERE r = 5 AND c = 7')
_Q["has_entry"] = (lambda s, d: m_square(s, d).cell(1, 95).agg((F.count(F.lit(1)) > 0).alias("found")), f"SELECT count(*) > 0 AS found FROM ({_SQUARE}) WHERE r = 1 AND c = 95")
_Q["row_slice"] = (lambda s, d: m_sparse(s, d).row_slice(17), f"SELECT {_OUT} FROM ({_SPARSE}) WHERE r = 17")
_Q["validate_coo"] = (lambda s, d: validate.coo_violations(SparseMatrix(m_dup(s, d).df, 60, 64)), f"SELECT count(*) AS nnz, count(*) FILTER (r >= 60 OR c >= 64) AS out_of_bounds, 0::BIGINT AS bad_values, count(*) FILTER (r >= 60 OR c >= 64) = 0 AS valid FROM ({_DUP})")
_Q["validate_csr"] = (lambda s, d: validate.csr_violations(m_dup(s, d)), f"SELECT sum(n)::BIGINT AS nnz, 0::BIGINT AS out_of_bounds, count(*) FILTER (n > 1) AS duplicate_cells, count(*) FILTER (n > 1) = 0 AS valid FROM (SELECT count(*) AS n FROM ({_DUP}) GROUP BY r, c)")
_Q["is_binary"] = (lambda s, d: validate.binary_sample(m_binary(s, d)).union(validate.binary_sample(m_sparse(s, d))), "SELECT unnest([true, false]) AS is_binary")

# ---- Collisions, counts, windows, layouts ----
_Q["merge_sum"] = (_merge("sum", m_dup), f"SELECT {_OUT} FROM ({_SUM})")
_Q["merge_avg"] = (_merge("avg", m_dup, 9), f'SELECT r AS "row", c AS col, round(avg(v), 9) + 0.0 AS "value" FROM ({_DUP}) GROUP BY 1, 2')
_Q["merge_max"] = (_merge("max", m_dup), f'SELECT r AS "row", c AS col, max(v) AS "value" FROM ({_DUP}) GROUP BY 1, 2')
_Q["merge_min"] = (_merge("min", m_dup), f'SELECT r AS "row", c AS col, min(v) AS "value" FROM ({_DUP}) GROUP BY 1, 2')
_Q["merge_last"] = (_merge("last", m_events), f'SELECT r AS "row", c AS col, arg_max(v, seq) AS "value" FROM ({_EVENTS}) GROUP BY 1, 2')
_Q["row_nnz"] = (lambda s, d: convert.row_counts(m_sparse(s, d)), f'SELECT r AS "row", count(*) AS nnz FROM ({_SPARSE}) GROUP BY 1')
_Q["col_nnz_all"] = (lambda s, d: convert.row_counts(m_square(s, d), "col", empty=True), f"SELECT k AS col, count(r) AS nnz FROM (SELECT unnest(range(0, {SIDE})) AS k) LEFT JOIN ({_SQUARE}) ON c = k GROUP BY 1")
_Q["row_ptr"] = (lambda s, d: convert.row_ptr(m_sparse(s, d)), f'SELECT k AS "row", coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start", (sum(n) OVER (ORDER BY k))::BIGINT AS "end" FROM (SELECT k, count(r) AS n FROM (SELECT unnest(range(0, {SIDE})) AS k) LEFT JOIN ({_SPARSE}) ON r = k GROUP BY 1)')
_Q["row_stats"] = (lambda s, d: convert.row_stats(m_square(s, d)), f"SELECT min(n) AS min_nnz, max(n) AS max_nnz, sum(n) / {SIDE}.0::DOUBLE AS avg_nnz FROM (SELECT k, count(r) AS n FROM (SELECT unnest(range(0, {SIDE})) AS k) LEFT JOIN ({_SQUARE}) ON r = k GROUP BY 1)")
_Q["global_nnz"] = (lambda s, d: m_dup(s, d).memory_estimate(), f"SELECT count(*) AS nnz, count(*) * 20 AS coordinate_bytes, count(*) * 12 + 65 * 8 AS compressed_bytes FROM ({_DUP})")
_Q["csr_nested"] = (lambda s, d: convert.to_csr(m_sparse(s, d)).select("row", F.size("cols").cast("long").alias("n"), F.array_join(F.col("cols").cast("array<string>"), ",").alias("cols"), F.aggregate("vals", F.lit(0.0), lambda a, x: a + x).alias("total")), f"""SELECT r AS "row", count(*) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) AS cols, sum(v) AS total FROM ({_SPARSE}) GROUP BY 1""")
_Q["csr_nested_roundtrip"] = (lambda s, d: _entries(convert.from_csr(convert.to_csr(m_dup(s, d), dedup="sum"), 64, 64)), f"SELECT {_OUT} FROM ({_SUM})")
_Q["intra_row_rank"] = (lambda s, d: convert.row_ranks(m_sparse(s, d)).select("row", "col", "rank"), f'SELECT r AS "row", c AS col, row_number() OVER (PARTITION BY r ORDER BY c) - 1 AS rank FROM ({_SPARSE})')
_Q["transpose"] = (lambda s, d: _entries(m_sparse(s, d).transposed()), f'SELECT c AS "row", r AS col, v AS "value" FROM ({_SPARSE})')
_Q["symmetric_expand"] = (lambda s, d: _entries(expand_symmetric(m_square(s, d))), f'SELECT {_OUT} FROM ({_SQUARE}) UNION ALL SELECT c, r, v FROM ({_SQUARE}) WHERE r <> c')
_Q["skew_expand"] = (lambda s, d: _entries(expand_symmetric(m_square(s, d), -1)), f'SELECT {_OUT} FROM ({_SQUARE}) UNION ALL SELECT c, r, -v FROM ({_SQUARE}) WHERE r <> c')
_Q["append_union"] = (lambda s, d: _entries(m_sum(s, d).append(m_sum(s, d).transposed()).merged("max")), f'SELECT r AS "row", c AS col, max(v) AS "value" FROM (SELECT r, c, v FROM ({_SUM}) UNION ALL SELECT c, r, v FROM ({_SUM})) GROUP BY 1, 2')
_Q["range_partition_counts"] = (lambda s, d: convert.row_owners(m_sparse(s, d), 7), f"SELECT p AS part, p * {SIDE // 7} + least(p, {SIDE % 7}) AS first_row, {SIDE // 7} + (p < {SIDE % 7})::BIGINT AS \"rows\", count(r) AS nnz FROM (SELECT unnest(range(0, 7)) AS p) LEFT JOIN ({_SPARSE}) ON r >= p * {SIDE // 7} + least(p, {SIDE % 7}) AND r < (p + 1) * {SIDE // 7} + least(p + 1, {SIDE % 7}) GROUP BY p")

# ---- Scaling ----
_S = (64, 64)
_Q["nearest_up2"] = (lambda s, d: _entries(m_dup(s, d).scale("nearest", 128, 128)), _nearest_sql(_DUP, _S, (128, 128)))
_Q["nearest_up3_gaps"] = (lambda s, d: _entries(m_dup(s, d).scale("nearest", 192, 192)), _nearest_sql(_DUP, _S, (192, 192)))
_Q["nearest_nonsquare"] = (lambda s, d: _entries(m_sparse(s, d).scale("nearest", TWICE, TWICE)), _nearest_sql(_SPARSE, (SIDE, NARROW), (TWICE, TWICE)))
for _p in ("avg", "max", "min"):
    _Q[f"nearest_{_p}"] = (lambda s, d, p=_p: _entries(m_dup(s, d).scale("nearest", 128, 128, policy=p), 9), _nearest_sql(_DUP, _S, (128, 128), f"round({_p}(v), 9) + 0.0"))
_Q["nearest_last"] = (lambda s, d: _entries(SparseMatrix(m_events(s, d).df.withColumn("row", F.col("row") % 64), 64, 64).scale("nearest", 128, 128, policy="last")), _nearest_sql(f"SELECT r % 64 AS r, c, v, seq FROM ({_EVENTS})", _S, (128, 128), "arg_max(v, seq)"))
_Q["bilinear_up2"] = (lambda s, d: _entries(m_dup(s, d).scale("bilinear", 128, 128)), _bilinear_sql(_SUM, _S, (128, 128)))
_Q["bilinear_down2"] = (lambda s, d: _entries(m_dup(s, d).scale("bilinear", 32, 32)), _bilinear_sql(_SUM, _S, (32, 32)))
_Q["bilinear_nonsquare"] = (lambda s, d: _entries(m_sparse(s, d).scale("bilinear", TWICE, TWICE)), _bilinear_sql(_SPARSE, (SIDE, NARROW), (TWICE, TWICE)))
_Q["bilinear_identity"] = (lambda s, d: _entries(m_zeros(s, d).scale("bilinear", 64, 64)), f"SELECT {_OUT} FROM ({_ZEROS}) WHERE v <> 0")
_Q["lanczos_up2"] = (lambda s, d: _entries(m_square(s, d).scale("lanczos", TWICE, TWICE), 8), _lanczos_sql(_SQUARE, SIDE, TWICE))
_Q["lanczos_down2"] = (lambda s, d: _entries(m_square(s, d).scale("lanczos", SIDE // 2, SIDE // 2), 8), _lanczos_sql(_SQUARE, SIDE, SIDE // 2))
_Q["fft_up2"] = (lambda s, d: _entries(m_sum(s, d).scale("fft", 128, 128, threshold=0.05), 6), _fft_sql(_SUM, _S, (128, 128), 0.05))
_Q["fft_threshold"] = (lambda s, d: _entries(m_folded(s, d).scale("fft", 72, 96, threshold=1.0), 6), _fft_sql(_FOLDED(96), (96, 96), (72, 96), 1.0))
_Q["wavelet_up2"] = (lambda s, d: _entries(m_sum(s, d).scale("wavelet", 128, 128)), _wavelet_sql(_SUM, 64, 128))
_Q["wavelet_identity"] = (lambda s, d: _entries(m_square(s, d).scale("wavelet", SIDE, SIDE)), f"SELECT {_OUT} FROM ({_SQUARE})")

# ---- Analysis ----


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_Q["matrix_stats"] = (lambda s, d: _rounded(analysis.matrix_stats(m_sparse(s, d))), f"""SELECT count(*) AS nnz, round(count(*) / {SIDE * NARROW}.0, 6) + 0.0 AS density, round(1 - count(*) / {SIDE * NARROW}.0, 6) + 0.0 AS sparsity, min(v) AS "min", max(v) AS "max", sum(v) AS "sum", round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(sqrt(sum(v * v)), 6) + 0.0 AS frobenius FROM ({_SPARSE})""")
_Q["stats_general"] = (lambda s, d: _rounded(analysis.stats_general(m_square(s, d))), f"""
    WITH m AS ({_SQUARE}), p AS (SELECT r, c FROM m), t AS (SELECT c AS r, r AS c FROM m),
    x AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM t)) AS shared, (SELECT count(*) FROM (SELECT * FROM p UNION SELECT * FROM t)) AS any_,
        (SELECT count(*) FROM m a FULL JOIN m b ON a.r = b.c AND a.c = b.r WHERE coalesce(a.v, 0) <> coalesce(b.v, 0)) AS unlike)
    SELECT {SIDE}::BIGINT AS n, count(*) AS nnz, round(count(*) / {SIDE * SIDE}.0, 6) + 0.0 AS density, (any_value(unlike) = 0)::INT AS sim, round(any_value(shared) / any_value(any_), 6) + 0.0 AS psym,
        count(*) FILTER (r = c AND v <> 0) AS diag, count(*) - count(*) FILTER (r = c AND v <> 0) AS ndg, max(abs(r - c)) AS band, (SELECT sum(f)::BIGINT FROM (SELECT max(abs(c - r)) AS f FROM m GROUP BY r)) AS profile,
        max(v) AS rmx, min(v) AS rmi, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS rstd, sum(v) AS "sum", round(stddev_pop(v) / abs(avg(v)), 6) + 0.0 AS dist FROM m, x""")
_FEATURES_SQL = """
    SELECT {n}::BIGINT AS n, count(*) AS nnz, round(count(*) / {n}.0 / {n}.0, 6) + 0.0 AS dens,
        round(coalesce(2.0 * (SELECT count(*) FROM {m} a JOIN {m} b ON a.r = b.c AND a.c = b.r WHERE a.r < a.c) / nullif(count(*) FILTER (r <> c), 0), 1.0), 6) + 0.0 AS psym, count(*) FILTER (r = c) AS diag,
        count(DISTINCT c - r) AS ndg, round(avg(abs(r - c)) / {n}.0, 6) + 0.0 AS dist, max(abs(r - c)) AS band, (SELECT sum(abs(r - f))::BIGINT FROM (SELECT r, min(c) AS f FROM {m} GROUP BY r)) AS profil,
        (SELECT max(k) FROM {m}_r) AS rmx, (SELECT min(k) FROM {m}_r WHERE k > 0) AS rmi, round((SELECT stddev_pop(k) FROM {m}_r), 6) + 0.0 AS rstd,
        (SELECT max(k) FROM {m}_c) AS cmx, (SELECT min(k) FROM {m}_c WHERE k > 0) AS cmi, round((SELECT stddev_pop(k) FROM {m}_c), 6) + 0.0 AS cstd FROM {m}"""


def _with_counts(name: str, base: str, n: int) -> str:
    count = lambda x: f"{name}_{x} AS (SELECT i, count({x}) AS k FROM (SELECT unnest(range(0, {n})) AS i) LEFT JOIN {name} ON {x} = i GROUP BY i)"
    return f"{name} AS ({base}), {count('r')}, {count('c')}"


_Q["features_square"] = (lambda s, d: _rounded(analysis.features_square(m_square(s, d))), f"WITH {_with_counts('m', _SQUARE, SIDE)} {_FEATURES_SQL.format(n=SIDE, m='m')}")
_UP_RCV = f'SELECT "row" AS r, col AS c, "value" AS v FROM ({_nearest_sql(_SQUARE, (SIDE, SIDE), (TWICE, TWICE))})'
_BI_RCV = f'SELECT "row" AS r, col AS c, "value" AS v FROM ({_bilinear_sql(_SQUARE, (SIDE, SIDE), (TWICE, TWICE))})'


def _scale_type_sql(rs: str, cs: str) -> str:
    like = f"abs({rs} - {cs}) < 1e-6"
    kind = f"CASE WHEN {rs} > 1 AND {cs} > 1 THEN 'Upscale' WHEN {rs} < 1 AND {cs} < 1 THEN 'Downscale' ELSE 'Scale' END"
    return f"CASE WHEN abs({rs} - 1.0) < 1e-6 AND abs({cs} - 1.0) < 1e-6 THEN 'Identity (1x)' WHEN {like} THEN {kind} || printf(' (Square %.2fx)', {rs}::DOUBLE) ELSE {kind} || printf(' (Non-square %.2fx%.2f)', {rs}::DOUBLE, {cs}::DOUBLE) END"


def _scaling_sql(before: str, n: tuple[int, int], after: str, m: tuple[int, int]) -> str:
    facts = lambda base: f"SELECT count(*)::DOUBLE AS n, coalesce(sum(v), 0.0) AS s, count(*) FILTER (r = c AND v <> 0)::DOUBLE AS g FROM ({base})"
    ratio = lambda x, y: f"CASE WHEN {y} > 0 THEN {x} / nullif({y}, 0) WHEN {x} = 0 THEN 0.0 ELSE 'inf'::DOUBLE END"
    diag = f"(CASE WHEN x.g > 0 THEN x.g * {f'{m[0]}.0 / {n[0]}' if m[0] * n[1] == m[1] * n[0] else f'least({m[0]}.0 / {n[0]}, {m[1]}.0 / {n[1]})'} ELSE 0 END)::DOUBLE"
    grown = f"(x.n * {m[0]}.0 / {n[0]} * {m[1]}.0 / {n[1]})::DOUBLE"
    method = f"CASE WHEN x.n = 0 THEN 'Unknown' WHEN abs(y.n - {grown}) < 1 THEN 'Nearest Neighbor' WHEN y.n > {grown} THEN 'Bilinear (likely)' ELSE 'Unknown' END"
    return f"""
        WITH x AS ({facts(before)}), y AS ({facts(after)})
        SELECT ({m[0]}.0 / {n[0]})::DOUBLE AS row_scale, ({m[1]}.0 / {n[1]})::DOUBLE AS col_scale, {_scale_type_sql(f'({m[0]}.0 / {n[0]})', f'({m[1]}.0 / {n[1]})')} AS scale_type, x.n::BIGINT AS before_nnz, y.n::BIGINT AS after_nnz,
            round({ratio('y.n', 'x.n')}, 6) + 0.0 AS nnz_ratio, {grown} AS expected_nnz, CASE WHEN x.n > 0 THEN abs(y.n - {grown}) < 1 ELSE y.n = 0 END AS nnz_match, x.g::BIGINT AS before_diag, y.g::BIGINT AS after_diag,
            round({ratio('y.g', 'x.g')}, 6) + 0.0 AS diag_ratio, {diag} AS expected_diag, CASE WHEN x.g > 0 THEN abs(y.g - {diag}) < 1 ELSE y.g = 0 END AS diag_match, x.s AS before_sum, y.s AS after_sum,
            round(CASE WHEN abs(x.s) > 1e-10 THEN y.s / x.s WHEN abs(y.s) < 1e-10 THEN 0.0 ELSE 'inf'::DOUBLE END, 6) + 0.0 AS sum_ratio, CASE WHEN abs(x.s) > 1e-10 THEN abs(y.s / x.s - 1) < 1e-6 ELSE abs(y.s) < 1e-10 END AS value_conserved,
            round({ratio(f'(y.n / {m[0] * m[1]}.0)', f'(x.n / {n[0] * n[1]}.0)')}, 6) + 0.0 AS density_ratio, {method} AS method FROM x, y"""


_SQ, _SQ2 = (SIDE, SIDE), (TWICE, TWICE)
_Q["compare_scaling"] = (lambda s, d: _rounded(analysis.compare_scaling(m_square(s, d), m_square(s, d).scale("nearest", TWICE, TWICE))), _scaling_sql(_SQUARE, _SQ, _UP_RCV, _SQ2))
_Q["compare_nonsquare"] = (lambda s, d: _rounded(analysis.compare_scaling(m_sparse(s, d), m_sparse(s, d).scale("nearest", TWICE, TWICE))), _scaling_sql(_SPARSE, (SIDE, NARROW), f'SELECT "row" AS r, col AS c, "value" AS v FROM ({_nearest_sql(_SPARSE, (SIDE, NARROW), _SQ2)})', _SQ2))
_Q["compare_same_factors"] = (lambda s, d: _rounded(analysis.compare_scaling(m_sparse(s, d), m_sparse(s, d).scale("bilinear", TWICE, SIDE))), _scaling_sql(_SPARSE, (SIDE, NARROW), f'SELECT "row" AS r, col AS c, "value" AS v FROM ({_bilinear_sql(_SPARSE, (SIDE, NARROW), (TWICE, SIDE))})', (TWICE, SIDE)))
_Q["compare_empty"] = (lambda s, d: _rounded(analysis.compare_scaling(m_none(s), SparseMatrix(m_square(s, d).df, SIDE, SIDE)).union(analysis.compare_scaling(m_none(s), m_none(s)))), f"SELECT * FROM ({_scaling_sql(_NONE, (256, 256), _SQUARE, _SQ)}) UNION ALL SELECT * FROM ({_scaling_sql(_NONE, (256, 256), _NONE, (256, 256))})")
_Q["detect_method"] = (lambda s, d: analysis.detect_method(m_square(s, d), m_square(s, d).scale("bilinear", TWICE, TWICE)), f"SELECT before_nnz, after_nnz, expected_nnz, method FROM ({_scaling_sql(_SQUARE, _SQ, _BI_RCV, _SQ2)})")
_SHAPES = [(256, 128, 512, 256), (256, 128, 512, 512), (256, 256, 128, 128), (256, 256, 512, 256), (256, 256, 128, 512), (100, 100, 100, 100), (256, 128, 64, 96)]
_Q["scale_types"] = (
    lambda s, d: s.createDataFrame([(*shape, analysis.scale_type(SparseMatrix.empty(s, *shape[:2]), SparseMatrix.empty(s, *shape[2:]))) for shape in _SHAPES], "r0 long, c0 long, r1 long, c1 long, scale_type string"),
    f"SELECT r0::BIGINT AS r0, c0::BIGINT AS c0, r1::BIGINT AS r1, c1::BIGINT AS c1, {_scale_type_sql('(r1::DOUBLE / r0)', '(c1::DOUBLE / c0)')} AS scale_type FROM (VALUES {', '.join(map(str, _SHAPES))}) AS t(r0, c0, r1, c1)",
)


def _compared_sql(base: str, n: int, scaled: str, m: int, power: float = 1.2) -> str:
    """The features of both side by side, with what the definition expects: (feature, original, generated, expected, good, diff_pct)."""
    s = m / n
    entries, line = s**power, s ** (power - 1)
    rows = [
        ("nnz", f"a.nnz * {entries!r}", 15), ("dens", f"a.dens * {entries!r} / {s * s!r}", 20), ("psym", "a.psym", 10), ("diag", f"a.diag * {s!r}", 25), ("ndg", f"least(a.ndg * {s!r}, {2 * m - 1})", 25),
        ("dist", "a.dist", 15), ("band", f"a.band * {s!r}", 15), ("profil", f"a.profil * {s * s!r}", 30), ("rmx", f"a.rmx * {line!r}", 40), ("rmi", f"greatest(1, a.rmi * {line!r})", 60), ("rstd", f"a.rstd * {line!r}", 40),
        ("cmx", f"a.cmx * {line!r}", 40), ("cmi", f"greatest(1, a.cmi * {line!r})", 60), ("cstd", f"a.cstd * {line!r}", 40),
    ]
    exact = lambda name, size: _FEATURES_SQL.format(n=size, m=name).replace("round(", "(").replace(", 6)", ")")
    listed = " UNION ALL ".join(f"SELECT '{f}' AS feature, a.{f}::DOUBLE AS original, b.{f}::DOUBLE AS generated, ({e})::DOUBLE AS expected, {good} AS good FROM a, b" for f, e, good in rows)
    return f"""{_with_counts('m', base, n)}, {_with_counts('u', scaled, m)}, a AS ({exact('m', n)}), b AS ({exact('u', m)}), f AS ({listed}),
        g AS (SELECT *, CASE WHEN expected <> 0 THEN 100.0 * abs(generated - expected) / abs(expected) WHEN generated = 0 THEN 0.0 ELSE 100.0 END AS diff_pct FROM f)"""


_COMPARED = _compared_sql(_SQUARE, SIDE, _UP_RCV, TWICE)
_PAIR = lambda s, d: (m_square(s, d), m_square(s, d).scale("nearest", TWICE, TWICE))
_Q["feature_comparison"] = (lambda s, d: _rounded(analysis.feature_comparison(*_PAIR(s, d)), 5), f"WITH {_COMPARED} SELECT feature, round(original, 5) + 0.0 AS original, round(generated, 5) + 0.0 AS generated, round(expected, 5) + 0.0 AS expected, round(diff_pct, 5) + 0.0 AS diff_pct, CASE WHEN diff_pct < good THEN 'GOOD' WHEN diff_pct < 30 THEN 'OK' ELSE 'POOR' END AS grade FROM g")
_Q["feature_score"] = (lambda s, d: _rounded(analysis.feature_score(*_PAIR(s, d)), 5), f"""
    WITH {_COMPARED}, t AS (SELECT sum(CASE WHEN feature = 'rstd' THEN 0.5 ELSE 1.0 END * diff_pct) / 6 AS score FROM g WHERE feature IN ('psym', 'dist', 'band', 'nnz', 'diag', 'rstd'))
    SELECT round(score, 5) + 0.0 AS score, 6::BIGINT AS features, CASE WHEN score < 10 THEN 'EXCELLENT' WHEN score < 20 THEN 'GOOD' WHEN score < 30 THEN 'OK' ELSE 'POOR' END AS grade FROM t""")
_Q["feature_bars"] = (lambda s, d: _rounded(analysis.feature_bars(*_PAIR(s, d)), 5), f"""
    WITH {_COMPARED}, t AS (SELECT feature, CASE WHEN original = 0 THEN 1.0 ELSE generated / (CASE WHEN feature = 'ndg' THEN original * 2.0 ELSE expected END) END AS ratio FROM g WHERE feature NOT IN ('dist', 'profil', 'rmi', 'cmi'))
    SELECT feature, round(ratio, 5) + 0.0 AS ratio, CASE WHEN abs(ratio - 1) < 0.1 THEN 'within 10%' WHEN abs(ratio - 1) < 0.25 THEN 'within 25%' ELSE 'beyond' END AS band FROM t""")
_TABLE = f"WITH {_COMPARED}, h AS (SELECT feature, original, generated FROM g UNION ALL SELECT 'n', {SIDE}.0, {TWICE}.0) SELECT feature, round(original, 6) + 0.0 AS original, round(generated, 6) + 0.0 AS generated, round(CASE WHEN original <> 0 THEN 100.0 * abs(generated - original) / abs(original) ELSE 0.0 END, 2) + 0.0 AS rel_diff_pct FROM h"
_Q["feature_table"] = (lambda s, d: _rounded(analysis.feature_table(*_PAIR(s, d))), _TABLE)


def comparison_csv(spark: SparkSession, d: str) -> DataFrame:
    """The feature table written as CSV and read back."""
    path = _scratch(spark, "comparison.csv")
    analysis.save_comparison_csv(*_PAIR(spark, d), path)
    return _rounded(spark.read.csv(path, header=True, schema="feature string, original double, generated double, rel_diff_pct double"))


_Q["comparison_csv"] = (comparison_csv, _TABLE)
_Q["stats_empty"] = (lambda s, d: analysis.stats_general(m_none(s)), "SELECT 256::BIGINT AS n, 0::BIGINT AS nnz, 0.0::DOUBLE AS density, 1::INT AS sim, 1.0::DOUBLE AS psym, 0::BIGINT AS diag, 0::BIGINT AS ndg, 0::BIGINT AS band, 0::BIGINT AS profile, 0.0::DOUBLE AS rmx, 0.0::DOUBLE AS rmi, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS rstd, 0.0::DOUBLE AS \"sum\", 0.0::DOUBLE AS dist")
_Q["features_empty"] = (lambda s, d: analysis.features_square(m_none(s)), "SELECT 256::BIGINT AS n, 0::BIGINT AS nnz, 0.0::DOUBLE AS dens, 1.0::DOUBLE AS psym, 0::BIGINT AS diag, 0::BIGINT AS ndg, 0.0::DOUBLE AS dist, 0::BIGINT AS band, 0::BIGINT AS profil, 0::BIGINT AS rmx, 0::BIGINT AS rmi, 0.0::DOUBLE AS rstd, 0::BIGINT AS cmx, 0::BIGINT AS cmi, 0.0::DOUBLE AS cstd")
_Q["spy_points"] = (lambda s, d: analysis.spy_points({"original": m_sparse(s, d), "transposed": m_sparse(s, d).transposed()}), f"SELECT 'original' AS name, r AS y, c AS x, 1::BIGINT AS count FROM ({_SPARSE}) UNION ALL SELECT 'transposed', c, r, 1 FROM ({_SPARSE})")
_Q["density_heatmap"] = (lambda s, d: analysis.density_heatmap(m_sparse(s, d), 16), f"SELECT (r * 16) // {SIDE} AS y, (c * 16) // {NARROW} AS x, count(*) AS count FROM ({_SPARSE}) GROUP BY 1, 2")
_Q["pattern_intersection"] = (lambda s, d: analysis.pattern_intersection(m_square(s, d)), f'SELECT r AS "row", c AS col FROM ({_SQUARE}) INTERSECT SELECT c, r FROM ({_SQUARE})')
_Q["pattern_union"] = (lambda s, d: analysis.pattern_union(m_square(s, d)), f'SELECT r AS "row", c AS col FROM ({_SQUARE}) UNION SELECT c, r FROM ({_SQUARE})')
_Q["value_asymmetry"] = (lambda s, d: analysis.value_asymmetry(m_square(s, d)), f'SELECT r AS "row", c AS col, sum(v) AS "value" FROM (SELECT r, c, v FROM ({_SQUARE}) UNION ALL SELECT c, r, -v FROM ({_SQUARE})) GROUP BY 1, 2 HAVING sum(v) <> 0')
_Q["diagonal_counts"] = (lambda s, d: m_square(s, d).df.groupBy((F.col("col") - F.col("row")).alias("diagonal")).agg(F.count(F.lit(1)).alias("nnz")), f"SELECT c - r AS diagonal, count(*) AS nnz FROM ({_SQUARE}) GROUP BY 1")


# ---- Files, streams, order, single precision ----


def mtx_roundtrip(spark: SparkSession, d: str, compressed: bool = False) -> DataFrame:
    """Written as a Matrix Market file (below the shared folder where one is named) and read back."""
    path = _scratch(spark, "roundtrip.mtx")
    write_mtx(m_sum(spark, d), path, compressed)
    return _entries(read_mtx(spark, path))


def mtx_source(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "source.mtx")
    write_mtx(m_sum(spark, d), path)
    register_mtx(spark)
    return spark.read.format("mtx").option("splits", 5).load(path)


def mtx_pattern(spark: SparkSession, d: str) -> DataFrame:
    """A pattern file of a symmetric matrix: values are 1, off-diagonal entries are mirrored, lines after the last entry are ignored."""
    path = _scratch(spark, "pattern.mtx")
    put_text(spark, path, "%%MatrixMarket matrix coordinate pattern symmetric\n% three entries\n4 4 3\n1 1\n3 1\n4 2\n9 9\n")
    return _entries(read_mtx(spark, path))


def mtx_csr_summed(spark: SparkSession, d: str) -> DataFrame:
    """A file with several lines a cell, read into the row-compressed layout."""
    path = _scratch(spark, "duplicates.mtx")
    write_mtx(m_dup(spark, d), path)
    return _entries(convert.from_csr(read_csr(spark, path), 64, 64))


def stream_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Entries that arrive as a stream of files, scaled as they come; the last state is written and read."""
    source, target, state = (_scratch(spark, f"stream-{k}") for k in ("in", "out", "state"))
    m_sum(spark, d).df.select(F.col("row").cast("long"), F.col("col").cast("long"), "value").repartition(3).write.parquet(source)
    stream = resample_stream(spark.readStream.schema("row long, col long, value double").option("maxFilesPerTrigger", 1).parquet(source), "nearest", (64, 64), (128, 128))
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
    return spark.read.parquet(target)


def refused_policy(spark: SparkSession, d: str) -> DataFrame:
    try:
        m_dup(spark, d).merged("median")
    except InvalidArgument:
        return spark.createDataFrame([(True,)], "refused boolean")
    return spark.createDataFrame([(False,)], "refused boolean")


def _builder(spark: SparkSession, d: str, policy: str) -> DataFrame:
    """Single entries, then a frame, then single entries of the same cells."""
    b = SparseMatrix.builder(spark, 64, 64).add_batch([(0, 0, 1.0), (1, 1, 2.0), (0, 0, 3.0)])
    b.add_batch(m_sum(spark, d).df).add_batch([(1, 1, -5.0), (2, 2, 7.0), (2, 2, 8.0)])
    return _entries(b.finalize(policy))


_BUILT = f"SELECT r, c, v, seq FROM (VALUES (0, 0, 1.0, 0), (1, 1, 2.0, 1), (0, 0, 3.0, 2), (1, 1, -5.0, 4), (2, 2, 7.0, 5), (2, 2, 8.0, 6)) AS t(r, c, v, seq) UNION ALL SELECT r, c, v, 3 FROM ({_SUM})"
_APPENDED = f"SELECT r, c, v, seq FROM ({_EVENTS}) UNION ALL SELECT c, r, v, seq + (SELECT max(event_id) - min(event_id) + 1 FROM events) FROM ({_EVENTS})"
_BILINEAR_NOISE = _bilinear_sql(_FOLDED(14), (14, 14), (34, 34))


def _f32_axis(n: int, m: int) -> str:
    s = f"({m}::FLOAT / {n}::FLOAT)"
    edge = lambda f, sign: f"greatest(least({f}(((s::FLOAT {sign} 0.5::FLOAT)::FLOAT * {s})::FLOAT), {m}), 0)::BIGINT"
    return f"SELECT s, unnest(range({edge('ceil', '-')}, {edge('floor', '+')})) AS d FROM (SELECT unnest(range(0, {n})) AS s)"


_Q["mtx_roundtrip"] = (mtx_roundtrip, f"SELECT {_OUT} FROM ({_SUM})")
_Q["mtx_compressed"] = (lambda s, d: mtx_roundtrip(s, d, True), f"SELECT {_OUT} FROM ({_SUM})")
_Q["mtx_source"] = (mtx_source, f"SELECT {_OUT} FROM ({_SUM})")
_Q["mtx_pattern"] = (mtx_pattern, 'SELECT r::BIGINT AS "row", c::BIGINT AS col, 1.0::DOUBLE AS "value" FROM (VALUES (0, 0), (2, 0), (0, 2), (3, 1), (1, 3)) AS t(r, c)')
_Q["mtx_csr_summed"] = (mtx_csr_summed, f"SELECT {_OUT} FROM ({_SUM})")
_Q["stream_nearest"] = (stream_nearest, _nearest_sql(_SUM, _S, (128, 128)))
_Q["refused_policy"] = (refused_policy, "SELECT true AS refused")
_Q["row_range"] = (lambda s, d: s.createDataFrame([convert.row_range(m_sparse(s, d), 17)], "first long, last long"), f"SELECT count(*) FILTER (r < 17) AS first, count(*) FILTER (r <= 17) AS last FROM ({_SPARSE})")
_Q["cleared"] = (lambda s, d: m_dup(s, d).clear().memory_estimate(), "SELECT 0::BIGINT AS nnz, 0::BIGINT AS coordinate_bytes, 65 * 8::BIGINT AS compressed_bytes")
_Q["builder_sum"] = (lambda s, d: _builder(s, d, "sum"), f'SELECT r AS "row", c AS col, sum(v)::DOUBLE AS "value" FROM ({_BUILT}) GROUP BY 1, 2')
_Q["builder_last"] = (lambda s, d: _builder(s, d, "last"), f'SELECT r AS "row", c AS col, arg_max(v, seq)::DOUBLE AS "value" FROM ({_BUILT}) GROUP BY 1, 2')
_Q["append_last"] = (lambda s, d: _entries(m_events(s, d).append(m_events(s, d).transposed()).merged("last")), f'SELECT r AS "row", c AS col, arg_max(v, seq) AS "value" FROM ({_APPENDED}) GROUP BY 1, 2')
_Q["bilinear_noise"] = (lambda s, d: _entries(m_folded(s, d, 14).scale("bilinear", 34, 34), 6), f'SELECT "row", col, round("value", 6) + 0.0 AS "value" FROM ({_BILINEAR_NOISE})')
_Q["bilinear_noise_transposed"] = (lambda s, d: _entries(m_folded(s, d, 14).transposed().scale("bilinear", 34, 34), 6), f'SELECT col AS "row", "row" AS col, round("value", 6) + 0.0 AS "value" FROM ({_BILINEAR_NOISE})')
_Q["nearest_f32"] = (lambda s, d: _entries(m_dup(s, d).scale("nearest", 150, 150, precision="f32")), f'WITH m AS ({_DUP}), k AS ({_f32_axis(64, 150)}) SELECT a.d AS "row", b.d AS col, sum(v)::DOUBLE AS "value" FROM m JOIN k a ON a.s = r JOIN k b ON b.s = c WHERE v <> 0 GROUP BY 1, 2')
_Q["lanczos_capped"] = (lambda s, d: _entries(m_square(s, d).scale("lanczos", TWICE, TWICE, candidate_cap=5000), 8), _lanczos_sql(_SQUARE, SIDE, TWICE, 5000))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for k, (q, _) in _Q.items()}
ORACLE_SQL: dict[str, str] = {k: sql for k, (_, sql) in _Q.items() if sql}
