import __spark_entry__ as entry


def test_entry_and_registry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["def_index", "date", "count", "total_count"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
