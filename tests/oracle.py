"""Compare registered queries with their SQL: python tests/oracle.py SF_DIR NAME..."""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return 0.0 if v == 0 else v if math.isfinite(v) else str(v)
        return tuple(cell(x) for x in v) if isinstance(v, list) else v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = canonical([tuple(r) for r in df.collect()], df.columns), canonical(rel.fetchall(), names)
    if a != b:
        return f"{len(a)} and {len(b)} rows; first differences {[x for x in zip(a, b) if x[0] != x[1]][:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from vecloom.plans.session import local_session

    spark = local_session(int(__import__("os").environ.get("CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    sql = e.oracle_sql()
    for name in sys.argv[2:] or sql:
        t = time.time()
        try:
            print(name, differences(spark, con, sys.argv[1], e.queries()[name], sql[name]) or "ok", f"{time.time() - t:.1f} s", flush=True)
        except Exception as x:
            print(name, "ERROR", str(x)[:600], flush=True)
