"""Compare registered queries with their SQL twins: python tools/check.py [-d folder] [names...]"""

import argparse
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from claimgrid import catalog
from claimgrid.session import get_spark
from claimgrid.sources.views import TABLES


def canon(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.6f}"
    if isinstance(value, Decimal):
        return f"{float(value):.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return repr(value)


def rows(table, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in table)


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", "--dir", default="/root/testdata/sf0.01")
    parser.add_argument("-p", "--prefix-module")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = get_spark("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{args.dir}/{table}.parquet'")
    registry = catalog.load_all()
    picked = [n for n, q in registry.items()
              if (not args.names or n in args.names)
              and (not args.prefix_module or q.build.__module__.endswith(args.prefix_module))]
    bad = 0
    for name in picked:
        entry = registry[name]
        try:
            start = time.time()
            df = catalog.run(name, spark, args.dir)
            got = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            if entry.sql is None:
                print(f"rows   {name:38s} {len(got):7d} {spent:6.2f}s", flush=True)
                continue
            start = time.time()
            cursor = con.execute(entry.sql)
            names = [d[0] for d in cursor.description]
            want = cursor.fetchall()
            duck = time.time() - start
            if sorted(names) != sorted(df.columns):
                bad += 1
                print(f"COLS   {name}: {sorted(df.columns)} vs {sorted(names)}", flush=True)
                continue
            a, b = rows(got, df.columns), rows(want, names)
            if a == b:
                print(f"ok     {name:38s} {len(got):7d} {spent:6.2f}s (sql {duck:5.2f}s)", flush=True)
            else:
                bad += 1
                print(f"DIFF   {name}: {len(a)} vs {len(b)} rows; columns {sorted(names)}", flush=True)
                only_a = [r for r in a if r not in set(b)][:3]
                only_b = [r for r in b if r not in set(a)][:3]
                for r in only_a: print("   spark", r)
                for r in only_b: print("   sql  ", r)
        except Exception as error:
            bad += 1
            print(f"ERROR  {name}: {str(error)[:1500]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
