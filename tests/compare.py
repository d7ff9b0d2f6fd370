"""Run catalog queries next to their SQL: `python tests/compare.py 0.01 [name ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(f"{DATA}/sf{sf}").glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(table: pd.DataFrame) -> pd.DataFrame:
    table = table[sorted(table.columns)].copy()
    for c in table.columns:
        if pd.api.types.is_numeric_dtype(table[c]) or pd.api.types.is_bool_dtype(table[c]):
            table[c] = table[c].astype("float64")
    keys = [c for c in ("symbol", "time", "event_id", "order_id", "trade_id") if c in table.columns]
    rest = [c for c in table.columns if c not in keys]
    return table.sort_values(keys + rest, na_position="first", ignore_index=True)


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None when equal, else the first reason."""
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    kinds = [(c, mine[c].dtype.kind, theirs[c].dtype.kind) for c in mine.columns]
    odd = [k for k in kinds if {k[1], k[2]} == {"i", "f"} or "M" in k[1:]]
    if odd:
        return f"types {odd}"
    a, b = canonical(mine), canonical(theirs)
    for c in a.columns:
        bad = [
            (i, x, y)
            for i, (x, y) in enumerate(zip(a[c], b[c]))
            if x != y and not (pd.isna(x) and pd.isna(y))
        ]
        if bad:
            return f"{c}: {len(bad)} differ, first {bad[:3]}"
    return None


def main(sf: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from barweave.session import local_session

    spark = local_session(8, **{"spark.driver.memory": "8g"})
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or queries:
        t0 = time.time()
        try:
            mine = queries[name](spark, f"{DATA}/sf{sf}").toPandas()
        except Exception as error:
            print(f"{name}: ERROR {str(error)[:1500]}", flush=True)
            failed.append(name)
            continue
        t1 = time.time()
        if name not in oracle:
            print(f"{name}: {len(mine)} rows, no SQL ({t1 - t0:.1f}s)", flush=True)
            continue
        try:
            why = difference(mine, con.execute(oracle[name]).df())
        except Exception as error:
            why = f"SQL {str(error)[:800]}"
        print(f"{name}: {why or 'same'} ({len(mine)} rows, {t1 - t0:.1f}s, SQL {time.time() - t1:.1f}s)", flush=True)
        if why:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
