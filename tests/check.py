"""Run registered queries next to their SQL: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return "nan"
        return f"{float(value):.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, name, query, statement):
    start = time.time()
    df = query(spark, folder)
    rows = df.collect()
    spent = time.time() - start
    if statement is None:
        return f"rows {len(rows)}", spent, not rows
    cursor = con.execute(statement)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", spent, True
    got, want = normalized(df.columns, rows), normalized(names, want)
    if got == want:
        return f"ok {len(got)}", spent, not got
    diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return f"DIFF {len(got)} vs {len(want)}: {str(diff)[:900]}", spent, True


def main(argv):
    import queries
    from tabloom.session import build_session

    folder = f"/root/testdata/{argv[0] if argv else 'sf0.01'}"
    wanted = argv[1:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), []
    statements = queries.all_sql()
    for name, query in queries.all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            message, spent, failed = compare(spark, con, folder, name, query, statements.get(name))
        except Exception as error:  # report and go on with the next query
            message, spent, failed = f"ERROR {str(error)[:1200]}", 0.0, True
        print(f"{'!!' if failed else '  '} {name:32s} {spent:6.1f}s  {message}", flush=True)
        bad += [name] if failed else []
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
