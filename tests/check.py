"""Compare registered Spark queries with their oracle SQL. Usage: check.py [--sf 0.01] [names...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 9))
    if type(value).__name__ == "Decimal":
        return repr(round(float(value), 9)) if value != value.to_integral_value() else int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql):
    """Empty string when equal, else what differs."""
    got_cols = spark_df.columns
    got = rows_of(got_cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} / {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}: {got[:3]} / {want[:3]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def main(argv):
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry
    from queryproof.session import local_session

    spark = local_session()
    con = duck(folder)
    sql = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if argv and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        start = time.time()
        try:
            if name in sql:
                msg = compare(fn(spark, folder), con, sql[name])
            else:
                n = fn(spark, folder).count()
                msg = "" if n else "no rows"
                name += " (rows only)"
        except Exception as exc:
            msg = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - start:.2f}s {msg}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    code = main(sys.argv[1:])
    sys.exit(bool(code))
