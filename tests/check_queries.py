"""Run the catalog against DuckDB: ``python tests/check_queries.py sf_dir [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    keys = df.map(lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v))
    order = keys.sort_values(list(keys.columns)).index
    return df.loc[order].reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None when equal up to row order and 1e-6 relative rounding."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    a, b = canonical(ours), canonical(theirs)
    for name in a.columns:
        for i, (x, y) in enumerate(zip(a[name], b[name])):
            if x is None or y is None:
                same = x is y
            elif isinstance(x, (int, float, np.number)) and isinstance(y, (int, float, np.number)):
                same = abs(x - y) <= 2e-6 * max(1.0, abs(x) * 1e-3)
            else:
                same = str(x) == str(y)
            if not same:
                return f"{name} row {i}: {x!r} vs {y!r}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import build_session

    options = [a for a in sys.argv[2:] if "=" in a]  # spark__name__of__option=value
    sf, names = sys.argv[1], [a for a in sys.argv[2:] if "=" not in a]
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", **dict(o.split("=") for o in options),
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    sql = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            result = query(spark, sf)
            ours = result.toPandas()
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name} {len(ours)} {took:.1f}s")
                continue
            theirs = con.execute(sql[name]).df()
            found = difference(ours, theirs)
        except Exception as error:  # report and go on with the next query
            found, took = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - start
            ours = pd.DataFrame()
        bad += found is not None
        print(f"{'FAIL' if found else 'ok'}  {name} {len(ours)} {took:.1f}s {found or ''}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
