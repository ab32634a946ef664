"""Compare registered queries with their SQL on the given tables."""

import glob
import os
import sys
import time

import duckdb


def canonical(value):
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    if isinstance(value, bool):
        return str(value)
    return "NULL" if value is None else str(value)


def compare(spark, sf_dir, name, function, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    started = time.time()
    df = function(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    took = time.time() - started
    if sql is None:
        return len(got), took, None
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns, (name, sorted(names), columns)
    order = [names.index(c) for c in columns]
    want = sorted(tuple(canonical(r[i]) for i in order) for r in result.fetchall())
    if got != want:
        missing = sorted(set(want) - set(got))[:3]
        surplus = sorted(set(got) - set(want))[:3]
        return len(got), took, f"{len(got)} rows against {len(want)}; {columns}; missing {missing}; surplus {surplus}"
    return len(got), took, None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    oracles = contract.oracle_sql()
    bad = 0
    for name, function in contract.queries().items():
        if chosen and name not in chosen:
            continue
        try:
            rows, took, problem = compare(session, sf_dir, name, function, oracles.get(name))
        except Exception as error:  # report and go on
            rows, took, problem = -1, 0.0, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={rows} {took:.2f}s {problem or ''}", flush=True)
    print("failures:", bad)
