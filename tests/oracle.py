"""Compare registered queries with their SQL twins in DuckDB (also usable as a script)."""

from __future__ import annotations

import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> list[str]:
    """Differences between a Spark result and a SQL result; empty when equal."""
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(want) != len(got):
        return [f"rows {len(got)} != {len(want)}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return [f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}"] if bad else []


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from remitlens.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(sf), entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracle:
                diff = compare(df, con, oracle[name])
                note = "ok" if not diff else "DIFF " + "; ".join(diff)[:600]
            else:
                note = f"rows-only {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            note = "ERROR " + str(e)[:700].replace("\n", " ")
        print(f"{name:28s} {time.time() - t:6.1f}s {note}", flush=True)
