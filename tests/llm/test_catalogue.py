import __spark_entry__
from orderloom.llm import catalogue


def test_registered():
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert {"p3_found", "p4_found", "p5_found", "p6_ids", "p7_packed", "p8_found"} <= set(catalogue.queries())
    assert set(catalogue.oracles()) <= set(catalogue.queries())


def test_columns(spark, data):
    expected = {"p3_found": ["address_a", "address_b"], "p4_found": ["name_a", "name_b"], "p5_found": ["email_id", "line_no"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "segment_no", "lang"]}
    for name, columns in expected.items():
        df = catalogue.queries()[name](spark, data)
        assert df.columns == columns
        if name != "p6_ids":
            assert df.count() == df.distinct().count()
