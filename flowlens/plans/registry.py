"""Registry of named queries: Spark callable + optional DuckDB twin.

Every registered callable takes ``(spark, sf_dir)`` and returns a DataFrame built with
the library's operators over the driver tables, with raw values.  Only the comparison with
the twins rounds (``rounded_oracle`` here, ``round_doubles`` on the Spark side in the driver
entry), because sums of doubles depend on their order in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.plans.views_sql import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its DuckDB twin (None: rows-only check)."""

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return deco


_ROUNDED: dict[str, str] = {}
DESCRIBE_DIR = "/root/testdata/sf0.001"


def rounded_oracle(digits: int = 6) -> dict[str, str]:
    """Twins whose DOUBLE / FLOAT output columns are wrapped in round(x, digits).

    Column types come from DuckDB's DESCRIBE (planning only) over the smallest driver tables
    (override with FLOWLENS_DESCRIBE_DIR).  The Spark side rounds with the same binary rule
    (``round_doubles``), so both engines emit identical doubles.  A twin that cannot be
    described is returned unchanged.
    """
    import os

    if _ROUNDED and len(_ROUNDED) == len(ORACLE):
        return dict(_ROUNDED)
    try:
        import duckdb

        from flowlens.sources.tables import TABLES, table_path

        base = os.environ.get("FLOWLENS_DESCRIBE_DIR", DESCRIBE_DIR)
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(base, t)}')")
    except Exception:  # noqa: BLE001 - no DuckDB or no data: leave the twins as they are
        return dict(ORACLE)
    for name, sql in ORACLE.items():
        try:
            cols = con.execute(f"DESCRIBE ({sql})").fetchall()
        except Exception:  # noqa: BLE001
            _ROUNDED[name] = sql
            continue
        dbl = [c[0] for c in cols if c[1] in ("DOUBLE", "FLOAT")]
        if not dbl:
            _ROUNDED[name] = sql
            continue
        repl = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in dbl)
        _ROUNDED[name] = f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS twin"
    return dict(_ROUNDED)


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from flowlens.plans import (q_alerts, q_eval, q_features, q_labels, q_models, q_prep,  # noqa: F401
                                q_profile, q_rules, q_streaming)
