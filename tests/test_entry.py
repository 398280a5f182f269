import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {x.kind for x in rows} <= {"dimension", "gdt", "theoretical", "note"}


def test_every_query_has_columns(spark):
    from tolmark import plans

    assert set(plans.oracle_sql()) <= set(plans.queries()) <= set(entry.queries())
    for name, q in plans.queries().items():
        assert q(spark, SF).columns, name
