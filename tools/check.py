"""Run catalog queries beside their SQL twins and report differences: tools/check.py [-s sf] [prefix ...]"""

import math
import re
import sys
import threading
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import duckdb

from inkframe import catalog
from inkframe.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


LIMIT = 60  # seconds per query


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(repr(v))
    return v


def main(argv):
    sf = "sf0.01"
    if argv[:1] == ["-s"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/{sf}"
    catalog.load()
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    names = [n for n in catalog.QUERIES if not argv or any(n == a or n.startswith(a) for a in argv)]
    bad = []
    for name in names:
        t0 = time.time()
        timer = threading.Timer(LIMIT, lambda: (con.interrupt(), spark.sparkContext.cancelAllJobs()))
        timer.start()
        try:
            df = catalog.QUERIES[name](spark, folder)
            rows = [tuple(map(canon, r)) for r in df.collect()]
            t1 = time.time()
            cols, types = df.columns, dict(df.dtypes)
            if name not in catalog.ORACLES:
                print(f"{'ok' if rows else 'EMPTY':8} {name:28} rows={len(rows)} spark={t1 - t0:.1f}s (no SQL) {rows[:1]}", flush=True)
                continue
            res = con.execute(catalog.ORACLES[name])
            ocols = [d[0] for d in res.description]
            otypes = {d[0]: str(d[1]) for d in res.description}
            orows = [tuple(map(canon, r)) for r in res.fetchall()]
            t2 = time.time()
            if sorted(cols) != sorted(ocols):
                raise AssertionError(f"columns {sorted(cols)} vs {sorted(ocols)}")
            want = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "int": "INTEGER"}
            odd = {c: (types[c], otypes[c]) for c in cols if want.get(types[c], types[c]) != otypes[c]}
            perm = sorted(range(len(cols)), key=lambda i: cols[i])
            operm = sorted(range(len(ocols)), key=lambda i: ocols[i])
            key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
            a = sorted((tuple(r[i] for i in perm) for r in rows), key=key)
            b = sorted((tuple(r[i] for i in operm) for r in orows), key=key)
            status = "ok" if a == b and not odd else "DIFF"
            if status == "ok" and not rows:
                status = "EMPTY"
            print(f"{status:8} {name:28} rows={len(rows)}/{len(orows)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s {odd or ''}", flush=True)
            if status != "ok":
                bad.append(name)
            if a != b:
                sa, sb = set(a), set(b)
                print("   cols ", sorted(cols))
                print("   spark", sorted(sa - sb, key=key)[:3])
                print("   duck ", sorted(sb - sa, key=key)[:3])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            msg = re.sub(r"\s+", " ", str(e))[:700]
            print(f"ERROR    {name:28} {type(e).__name__}: {msg}", flush=True)
            if not msg:
                traceback.print_exc()
        finally:
            timer.cancel()
    print(f"{len(names) - len(bad)}/{len(names)} fine; bad: {bad}")


main(sys.argv[1:])
