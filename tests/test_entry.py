import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs_and_has_rows(spark):
    mod = _entry()
    df = mod.entry(spark)
    assert df.columns == ["hour", "total", "attacks", "normal"]
    rows = df.collect()
    assert len(rows) > 0
    assert sum(r["total"] for r in rows) == 1000
    assert all(r["total"] == r["attacks"] + r["normal"] for r in rows)


def test_contract_keys():
    mod = _entry()
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
