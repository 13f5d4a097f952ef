"""Run registered queries next to their SQL on DuckDB.

python tests/check_queries.py [sf_dir] [key or prefix* ...]
CADENZA_GROUP_ROWS=40 makes every group above 40 rows take the sliced plan.
"""

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        f = float(v)
        return "nan" if math.isnan(f) else (f"{f:.9g}" if f != 0 else "0")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    return str(v)


def table_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    import duckdb

    import __spark_entry__ as entry
    from cadenza.core.session import get_session

    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in args if not a.startswith("/")]
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    if "CADENZA_GROUP_ROWS" in os.environ:
        spark.conf.set("spark.cadenza.groupRows", os.environ["CADENZA_GROUP_ROWS"])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for k in queries:
        if keys and not any(k == x or (x.endswith("*") and k.startswith(x[:-1])) for x in keys):
            continue
        t0 = time.time()
        try:
            df = queries[k](spark, sf)
            cols, got = table_rows(df.columns, df.collect())
            t1 = time.time()
            if k not in oracles:
                print(f"{k:6} rows={len(got):7} {t1 - t0:6.1f}s  no SQL", flush=True)
                continue
            cur = con.execute(oracles[k])
            ocols, want = table_rows([c[0] for c in cur.description], cur.fetchall())
            ok = cols == ocols and got == want
            print(f"{k:6} rows={len(got):7} {t1 - t0:6.1f}s  {time.time() - t1:5.1f}s {'ok' if ok else 'DIFF'}", flush=True)
            if not ok:
                bad.append(k)
                print("   spark", cols, len(got), "\n   duck ", ocols, len(want))
                diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
                for g, w in diff:
                    print("    S", str(g)[:300], "\n    D", str(w)[:300])
        except Exception as e:  # noqa: BLE001
            bad.append(k)
            print(f"{k:6} ERROR {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
