import pytest

from latticework.plans import catalogue

from .conftest import SF_DIR, same_rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, SF_DIR), duck, catalogue.ORACLE_SQL[name])


def test_entry_imports_and_lists(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_matrices_hold_all_rows(spark, duck):
    rows, total = duck.execute("SELECT count(DISTINCT (l_partkey, l_orderkey)), sum(l_quantity) FROM lineitem").fetchone()
    for make in (catalogue.m_square, catalogue.m_sparse, catalogue.m_folded):
        m = make(spark, SF_DIR)
        assert m.df.agg({"value": "sum"}).first()[0] == total
        assert make is catalogue.m_folded or m.nnz() == rows
        assert make is catalogue.m_folded or rows < m.n_rows * m.n_cols / 100
    assert not any("WHERE l_quantity" in sql for sql in catalogue.ORACLE_SQL.values())
