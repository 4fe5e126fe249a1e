"""Run registered queries in Spark and their SQL twins in DuckDB, and compare values.

Usage: python -m tests.oracle [sf_dir] [name ...]; a name may be a prefix.
"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = []
    for values in zip(*[frame[c].tolist() for c in columns]):
        rows.append(tuple(_plain(v) for v in values))
    return sorted(rows, key=repr)


def _plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return float(v)
    return v


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype) for c in sorted(frame.columns)}


def difference(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    """None if equal, else a short description."""
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(duck_frame.columns)}"
    a, b = canonical(spark_frame), canonical(duck_frame)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0][0]} != {wrong[0][1]}"
    ka, kb = kinds(spark_frame), kinds(duck_frame)
    off = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c] and {ka[c], kb[c]} != {"object", "str"}}
    return f"types {off}" if off else None


def main(argv: list[str]) -> int:
    from riskgrove.catalog import REGISTRY
    from riskgrove.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, query in REGISTRY.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            got = query.build(spark, sf_dir).toPandas()
            took = time.time() - start
            start = time.time()
            if query.sql is None:
                verdict = f"rows only: {len(got)} rows, {list(got.columns)}"
            else:
                verdict = difference(got, con.execute(query.sql).fetchdf())
                verdict = "ok" if verdict is None else "DIFF " + verdict
        except Exception as error:  # noqa: BLE001
            took = time.time() - start
            verdict = "FAIL " + str(error)[:1500]
        bad += verdict.startswith(("DIFF", "FAIL"))
        print(f"{name:34s} spark {took:6.2f}s duck {time.time() - start:5.2f}s  {verdict}", flush=True)
    print("bad:", bad)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
