"""python tests/compare.py [--sf DIR] NAME...: holds queries against their SQL in DuckDB, all of them without a name."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def plain(v) -> str:
    """Numbers to 6 places, dates as text; null and NaN are told apart."""
    if v is None:
        return "null"
    if isinstance(v, (bool, str)):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    try:
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    except (TypeError, ValueError):
        return str([plain(x) for x in v]) if hasattr(v, "__len__") else str(v)


def rows(names: list[str], found: list[tuple]) -> list[tuple]:
    """Sorted rows with columns in order of their names."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


def compare(name: str, query, sql: str | None, spark, sf_dir: str) -> str:
    t = time.time()
    df = query(spark, sf_dir)
    mine = df.collect()
    took = time.time() - t
    if sql is None:
        return f"rows {len(mine)} {took:.1f}s"
    names, theirs = oracle(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"COLUMNS {sorted(df.columns)} {sorted(names)}"
    a, b = rows(df.columns, mine), rows(names, theirs)
    if a == b:
        return f"match {len(a)} {took:.1f}s"
    in_a, in_b = set(a), set(b)
    only = [x for x in a if x not in in_b], [x for x in b if x not in in_a]
    return f"DIFFER {len(a)} {len(b)} {len(only[0])} {len(only[1])} {only[0][:3]} {only[1][:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from terravane.session import build

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    session = build(master="local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g", spark_driver_host="127.0.0.1", spark_ui_showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    for n in args or q:
        try:
            print(n, compare(n, q[n], o.get(n), session, sf), flush=True)
        except Exception as x:  # noqa: BLE001
            print(n, "ERROR", str(x)[:1500], flush=True)
