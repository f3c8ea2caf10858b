from kinsift.llm import catalog


def test_sql_is_text():
    assert set(catalog.oracle_sql()) == {"p3_found", "p4_found"}
    assert all(isinstance(q, str) for q in catalog.oracle_sql().values())
