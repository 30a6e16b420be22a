import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_queries_run_and_match_sql(spark):
    import duckdb

    from stratawright.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    columns = {"p1_found": ["post_id_a", "post_id_b"], "p2_found": ["post_id", "field", "kind", "start_pos"], "p3_found": ["record_kind", "record_id", "field", "lang"], "p4_found": ["post_id", "category"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id"], "p8_found": ["doc_id", "subject"]}
    for name, query in QUERIES.items():
        df = query(spark, DATA)
        rows = df.collect()
        if name in columns:
            assert df.columns == columns[name]
        if name.endswith("_found"):
            assert len(rows) == len(set(rows))
        if name in SQL:
            names = sorted(df.columns)
            want = con.sql("SELECT " + ", ".join(names) + f" FROM ({SQL[name]})").fetchall()
            assert sorted(repr(tuple(r[c] for c in names)) for r in rows) == sorted(repr(tuple(r)) for r in want)
