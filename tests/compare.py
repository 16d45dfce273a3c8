"""Run registered queries beside their DuckDB oracles: python tests/compare.py [NAME...] [--sf sf0.01]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path("/root/testdata")


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def difference(spark: SparkSession, name: str, query, sql: str | None, sf_dir: str) -> str:  # noqa: ANN001
    """What differs, or an empty string."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return ""
    columns, want = oracle(sql, sf_dir)
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} but the oracle has {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{name}: {len(a)} and {len(b)} rows; only here {only_a}; only in the oracle {only_b}"


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


if __name__ == "__main__":
    import __spark_entry__ as e

    sf = sys.argv[sys.argv.index("--sf") + 1] if "--sf" in sys.argv else "sf0.01"
    names = [x for x in sys.argv[1:] if not x.startswith("--") and x != sf] or list(e.queries())
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for n in names:
        t = time.time()
        try:
            said = difference(spark, n, e.queries()[n], e.oracle_sql().get(n), f"{DATA}/{sf}")
        except Exception as x:  # noqa: BLE001
            said = f"{n}: {str(x)[:1500]}"
        bad += bool(said)
        print(f"\n{n}: {'same' if not said and n in e.oracle_sql() else 'ran' if not said else said} ({time.time() - t:.1f} s)", flush=True)
    print("differences:", bad)
