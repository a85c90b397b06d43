import __spark_entry__ as e


def test_entry_and_registry(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "masked", "n_spans"]
