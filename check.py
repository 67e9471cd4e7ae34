"""Compare registered queries with their reference SQL: python check.py [-s SF_DIR] [AREA | QUERY ...]"""
import argparse
import importlib
import math
import time

import duckdb

from sheetmetric.queries import AREAS
from sheetmetric.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(spark, con, query, sql, sf_dir):
    """Problem text ('' when equal), rows, Spark seconds."""
    start = time.time()
    df = query(spark, sf_dir)
    left = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return ("" if left else "no rows"), len(left), took
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    right = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} <> {sorted(columns)}", len(left), took
    kinds = {c: t for c, t in df.dtypes}
    sql_kinds = {d[0]: str(d[1]) for d in cur.description}
    names = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    bad = [f"{c}: {k} <> {sql_kinds[c]}" for c, k in kinds.items() if names.get(k, k) != sql_kinds[c] and sql_kinds[c] not in ("NUMBER", "STRING", "bool")]
    a, b = canonical(left, df.columns), canonical(right, columns)
    if len(a) != len(b):
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return f"rows {len(a)} <> {len(b)}; only spark {sorted(sa - sb)[:2]}; only sql {sorted(sb - sa)[:2]}", len(left), took
    exact = a == b
    for x, y in zip(a, b):
        if not all(same(p, q) for p, q in zip(x, y)):
            diff = sum(1 for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x, y)))
            return f"{diff} rows differ, columns {sorted(columns)}:\n   spark {x}\n   sql   {y}", len(left), took
    note = "" if exact else "floats differ in the last digits"
    return "; ".join(([note] if note else []) + (["types " + ", ".join(bad)] if bad else [])) + ("; empty" if not a else ""), len(left), took


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("-s", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    areas = [n for n in args.names if n in AREAS] or (AREAS if not args.names else AREAS)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.s)
    wanted = [n for n in args.names if n not in AREAS]
    failed = 0
    for area in areas:
        module = importlib.import_module(f"sheetmetric.queries.{area}")
        for name, query in module.QUERIES.items():
            if wanted and name not in wanted:
                continue
            try:
                problem, rows, took = compare(spark, con, query, module.ORACLES.get(name), args.s)
            except Exception as err:  # report and go on with the next query
                con = connect(args.s)
                problem, rows, took = f"{type(err).__name__}: {str(err)[:700]}", 0, 0
            failed += bool(problem)
            print(f"{'ok  ' if not problem else 'FAIL'} {name} rows={rows} {took:.2f}s {'' if name in module.ORACLES else '(rows only)'} {problem}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
