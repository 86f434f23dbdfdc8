"""Compare registered queries with their SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(table):
    """Column names and sorted rows; whole numbers of any type compare equal."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]

    def value(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        if isinstance(x, (int, float)):
            return round(float(x), 6) + 0.0
        return x if not isinstance(x, list) else tuple(x)

    rows = [tuple(value(x) for x in row) for row in zip(*columns)]
    return names, sorted(rows, key=repr)


def compare(spark, con, folder, name, query, sql):
    """None when both agree, else what differs."""
    got = query(spark, folder).toArrow()
    if sql is None:
        return None if got.num_rows else "no rows"
    names, rows = normal(got)
    want_names, want = normal(con.sql(sql).to_arrow_table())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    for a, b in zip(rows, want):
        if a != b:
            return f"{a} != {b}"
    return None if rows else "no rows"


def main():
    from scansio.checks import ORACLES, QUERIES
    from scansio.session import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree, {sum(n in ORACLES for n in names)} by SQL")
    spark.stop()


if __name__ == "__main__":
    main()
