import __spark_entry__ as e


def test_registry_and_flagship(spark):
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and "bm25_or_top" in q
    out = e.entry(spark)
    assert out.columns == ["id", "score"] and out.count() > 0
