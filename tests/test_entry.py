import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in range(1, 6):
        assert any(q.startswith(f"p{n}_") for q in entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
