"""Run the named queries and their SQL twins side by side: ``python tests/compare.py <sf_dir> [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """Empty text if both sides agree, else the first difference."""
    df = query(spark, sf_dir)
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got[1] else "no rows"
    res = con.execute(sql)
    want = as_rows([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    kinds = [{type(v) for v in col if v is not None} for col in zip(*got[1])] if got[1] else []
    wanted = [{type(v) for v in col if v is not None} for col in zip(*want[1])] if want[1] else []
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}"
    if kinds != wanted:
        return f"types {list(zip(got[0], kinds, wanted))}"
    for g, w in zip(got[1], want[1]):
        if g != w:
            return f"{got[0]}: {g} against {w}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from teleproof.settings import session

    spark, con = session("compare"), connection(sf_dir)
    queries, twins = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or queries:
        start = time.time()
        try:
            issue = compare(spark, con, name, queries[name], twins.get(name), sf_dir)
        except Exception as error:
            issue = f"{type(error).__name__}: {str(error)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        print(f"{'ok  ' if not issue else 'FAIL'} {name} {time.time() - start:.1f}s {issue[:900]}", flush=True)
        if issue:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "-v"]
    sys.exit(1 if main(args[0], args[1:]) else 0)
