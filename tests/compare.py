"""Compare registered queries with their SQL: python -m tests.compare SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def oracle(base: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(base).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con.execute(sql).fetchdf()


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        if isinstance(x, float) or type(x).__name__ in ("float32", "float64", "Decimal"):
            return f"{float(x):.6f}".replace("-0.000000", "0.000000")
        if hasattr(x, "__len__") and not isinstance(x, str):
            return str([one(y) for y in x])
        return str(x)

    return sorted(tuple(one(x) for x in row) for row in df[cols].itertuples(index=False))


def main() -> None:
    import __spark_entry__ as e

    from fieldglass.session import local_session

    base, names = sys.argv[1], sys.argv[2:]
    spark = local_session(cores="8")
    bad = 0
    for name, f in e.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        got = f(spark, base).toPandas()
        took = time.time() - began
        sql = e.oracle_sql().get(name)
        if sql is None:
            print(f"{name}: {len(got)} rows, no SQL, {took:.1f} s", flush=True)
            continue
        want = oracle(base, sql)
        a, b = canonical(got), canonical(want)
        same = sorted(got.columns) == sorted(want.columns) and a == b
        bad += not same
        print(f"{name}: {'same' if same else 'DIFFERENT'}, {len(a)} and {len(b)} rows, {took:.1f} s", flush=True)
        if not same:
            print("  columns", sorted(got.columns), sorted(want.columns))
            print("  only here", sorted(set(a) - set(b))[:3])
            print("  only SQL ", sorted(set(b) - set(a))[:3])
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
