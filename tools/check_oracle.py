"""Compare registered queries with their SQL: python tools/check_oracle.py [substring ...] [--sf DIR]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from cohortlens import catalog
from cohortlens.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, dict):
        return sorted((str(k), plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def main(argv):
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    catalog.load_all()
    exact = [a[1:] for a in argv if a.startswith("=")]
    parts = [a for a in argv if not a.startswith("=")]
    names = [n for n in catalog.QUERIES
             if (not argv) or n in exact or any(a in n or a == catalog.QUERIES[n].__module__.split(".")[-1] for a in parts)]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad, slow = [], []
    for name in names:
        begin = time.time()
        try:
            df = catalog.QUERIES[name](spark, sf)
            got = [tuple(r) for r in df.collect()]
            spent = time.time() - begin
            slow.append((spent, name))
            columns, mine = rows_of(df.columns, got)
            plan = df._jdf.queryExecution().executedPlan().toString()
            flags = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if w in plan]
            note = f"{len(mine)} rows {spent:.1f}s {' '.join(flags)}"
            if name in catalog.ORACLE:
                t1 = time.time()
                rel = con.sql(catalog.ORACLE[name])
                theirs_columns, theirs = rows_of(rel.columns, rel.fetchall())
                note += f" duck {time.time() - t1:.1f}s"
                if columns != theirs_columns:
                    raise AssertionError(f"columns {columns} != {theirs_columns}")
                if len(mine) != len(theirs):
                    raise AssertionError(f"rows {len(mine)} != {len(theirs)}: {mine[:2]} {theirs[:2]}")
                diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
                if diff:
                    raise AssertionError(f"{len(diff)} of {len(mine)} rows differ; first {diff[0]}")
                types = dict(df.dtypes)
                for c, t in zip(rel.columns, rel.types):
                    if str(t) in ("HUGEINT",) or (str(t) == "DOUBLE") != (types[c] == "double"):
                        note += f" [type {c}: {types[c]} vs {t}]"
            else:
                note += " (no SQL)"
            if not mine:
                note += " EMPTY"
            print("ok  ", name, note, flush=True)
        except Exception as error:
            bad.append(name)
            text = str(error)
            print("FAIL", name, type(error).__name__, text[:700].replace("\n", " "), flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
        spark.catalog.clearCache()
    print(f"{len(names) - len(bad)} ok, {len(bad)} failed: {bad}")
    print("slowest:", [(n, round(s, 1)) for s, n in sorted(slow, reverse=True)[:8]])


if __name__ == "__main__":
    main(sys.argv[1:])
