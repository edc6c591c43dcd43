"""Run every registered query next to its SQL check and compare strictly.

    python tests/check_oracles.py [sf folder] [name part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT",
         "timestamp_ntz": "TIMESTAMP"}


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark_df, con, sql):
    cur = con.execute(sql)
    got_cols = [(d[0], str(d[1])) for d in cur.description]
    want = cur.fetchall()
    names = sorted(c for c, _ in got_cols)
    problems = []
    if names != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {names}"], len(want)
    types = dict(got_cols)
    for c, t in spark_df.dtypes:
        if TYPES.get(t, t) != types[c]:
            problems.append(f"type {c}: {t} vs {types[c]}")
    order = {c: i for i, (c, _) in enumerate(got_cols)}
    a = sorted((tuple(norm(r[c]) for c in names) for r in spark_df.collect()), key=key)
    b = sorted((tuple(norm(r[order[c]]) for c in names) for r in want), key=key)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} rows differ; {names}\n     spark {bad[0][0]}\n     sql   {bad[0][1]}")
    if not want:
        problems.append("empty result")
    return problems, len(want)


def main():
    import __spark_entry__
    from fieldweave.session import local_session

    QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()  # noqa: N806
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(folder)
    failed = []
    for name, fn in QUERIES.items():
        if args and not any(name.startswith(p) if p.endswith("_") else p in name for p in args):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in ORACLES:
                problems, n = compare(df, con, ORACLES[name])
            else:
                n = df.count()
                problems = [] if n else ["no rows"]
        except Exception as e:  # noqa: BLE001
            problems, n = [str(e)[:1500]], -1
        mark = "ok  " if not problems else "FAIL"
        print(f"{mark} {name} rows={n} {time.time() - t0:.1f}s{'' if name in ORACLES else ' (rows only)'}", flush=True)
        for p in problems:
            print("   ", p, flush=True)
        if problems:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
