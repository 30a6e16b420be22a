import os
import sys

import pytest

import __spark_entry__ as entry
from stratawright import session

DATA = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_core_without_the_subpackage(monkeypatch):
    """A subpackage that cannot be imported, or is gone but for its cache, leaves the core queries."""
    for name in [n for n in sys.modules if n.startswith("stratawright.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "stratawright.llm", None)
    queries = entry.queries()
    assert len(queries) > 50 and not [n for n in queries if n.startswith("p")]


def test_cut_refuses_a_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("Sc", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})())

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)
    assert session.LOCAL.fullmatch("local[8]") and session.LOCAL.fullmatch("local") and not session.LOCAL.fullmatch("local-cluster[3,2,1000]")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_core_queries_match_sql(spark):
    import duckdb

    from stratawright.queries import registry

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    queries = entry.queries()
    for name, sql in registry.SQL.items():
        df = queries[name](spark, DATA)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
        want = sorted(repr(tuple(r)) for r in con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall())
        assert got == want, name


def broadcast(df):
    """Text of the plan below each broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            yield "\n".join(lines[i : next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_questions_are_never_broadcast(spark):
    """Spark guesses rows behind an explode by the file they come from, which is small even when the questions are not."""
    for name in ("M7_evaluate_local", "J7_J9_remaining"):
        for part in broadcast(entry.queries()[name](spark, DATA)):
            assert "post_id" not in part, name
