import __spark_entry__


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40
