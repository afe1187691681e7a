"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Comparison: column names (sorted), row count, value multiset (order-insensitive
hash of the rows after sorting columns by name). Used by the tests and runnable
directly: ``python tests/oracle.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def frame_hash(pdf: pd.DataFrame) -> tuple[list[str], int, str]:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return cols, len(rows), h


def compare(spark, con, name: str, sf_dir: str) -> dict:
    from sparkrisk.plans import model_queries  # noqa: F401  (registers model queries)
    from sparkrisk.plans.registry import ORACLE_SQL, QUERIES
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    spdf = pd.DataFrame([r.asDict() for r in sdf.collect()], columns=sdf.columns)
    t1 = time.time()
    out = {"name": name, "spark_rows": len(spdf), "spark_sec": round(t1 - t0, 2)}
    if name not in ORACLE_SQL:
        out["oracle"] = "none"
        return out
    opdf = con.sql(ORACLE_SQL[name]).df()
    sc, sn, sh = frame_hash(spdf)
    oc, on, oh = frame_hash(opdf)
    out.update(oracle_rows=on, cols_match=sc == oc, rows_match=sn == on, hash_match=sh == oh)
    if sc != oc:
        out["cols"] = (sc, oc)
    if sh != oh and sc == oc:
        a = spdf[sc].astype(object).map(_norm).apply("|".join, axis=1)
        b = opdf[oc].astype(object).map(_norm).apply("|".join, axis=1)
        only_s = sorted(set(a) - set(b))[:3]
        only_o = sorted(set(b) - set(a))[:3]
        out["diff"] = {"spark_only": only_s, "oracle_only": only_o}
    return out


def main(argv: list[str]) -> int:
    from sparkrisk.plans import model_queries  # noqa: F401
    from sparkrisk.plans.registry import QUERIES
    from sparkrisk.session import local_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "error": f"{type(e).__name__}: {str(e)[:300]}"}
        ok = r.get("oracle") == "none" or (r.get("hash_match") and r.get("cols_match"))
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
