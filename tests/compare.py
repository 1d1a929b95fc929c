"""Run registered queries beside their SQL and report differences in names, types and values."""

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "array<string>": "VARCHAR[]",
}


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def compare(spark, con, folder, name, query, sql):
    started = time.time()
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    cols = sorted(kinds)
    if sql is None:
        return None, len(rows), took
    con.execute(sql)
    described = {d[0]: str(d[1]) for d in con.description}
    theirs_rows = con.fetchall()
    problems = []
    if sorted(described) != cols:
        return [f"columns {sorted(set(described) ^ set(cols))}"], len(rows), took
    for c in cols:
        want = KINDS.get(kinds[c], kinds[c].upper())
        if want.replace(" ", "") != described[c].replace(" ", ""):
            problems.append(f"type of {c}: {kinds[c]} / {described[c]}")
    a = df.columns
    b = list(described)
    mine = sorted(tuple(plain(r[a.index(c)]) for c in cols) for r in rows)
    theirs = sorted(tuple(plain(r[b.index(c)]) for c in cols) for r in theirs_rows)
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} / {len(theirs)}")
    if mine != theirs:
        only = [x for x in mine if x not in set(theirs)][:2]
        other = [x for x in theirs if x not in set(mine)][:2]
        problems.append(f"values differ: {cols}\n     spark {only}\n     sql   {other}")
    return problems, len(rows), took


def main(names, folder):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from larder.session import build_session

    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        try:
            problems, n, took = compare(spark, con, folder, name, query, oracle.get(name))
        except Exception as e:  # report and go on to the next query
            problems, n, took = [f"{type(e).__name__}: {str(e)[:700]}"], -1, 0.0
        state = "rows only" if problems is None else "ok" if not problems else "BAD"
        bad += state == "BAD"
        print(f"{state:9} {name:28} {n:7} rows {took:6.2f}s", flush=True)
        for p in problems or []:
            print("   ", p, flush=True)
    print("bad:", bad, "unknown oracle keys:", sorted(set(oracle) - set(entry.queries())))


if __name__ == "__main__":
    main(set(sys.argv[1:]), os.environ.get("SF_DIR", "/root/testdata/sf0.01"))
