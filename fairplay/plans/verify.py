"""Compare a registered Spark job with its DuckDB twin (used by tests and the CLI).

python -m fairplay.plans.verify [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import pandas as pd

from fairplay.sources.tables import TABLES


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm_value(v):
    import datetime

    import numpy as np

    if isinstance(v, np.generic):
        v = v.item()
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        v = v + 0.0  # -0.0 -> 0.0; values are compared exactly
        return int(v) if v.is_integer() else v
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, datetime.date):
        return datetime.datetime.combine(v, datetime.time())
    if isinstance(v, np.ndarray):
        return tuple(_norm_value(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm_value(x)) for k, x in v.items()))
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm_value(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from fairplay.plans.catalog import load_all

    entry = load_all()[name]
    con = con or duckdb_connection(sf_dir)
    t0 = time.time()
    sdf = entry.build(spark, sf_dir)
    spark_pdf = sdf.toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(spark_pdf), "spark_sec": round(t1 - t0, 2)}
    if entry.sql is None:
        res["status"] = "no-sql"
        return res
    oracle_pdf = con.execute(entry.sql).df()
    res["oracle_rows"] = len(oracle_pdf)
    s_cols, o_cols = sorted(spark_pdf.columns), sorted(oracle_pdf.columns)
    if s_cols != o_cols:
        res["status"] = "schema"
        res["detail"] = f"spark-only {sorted(set(s_cols) - set(o_cols))} oracle-only {sorted(set(o_cols) - set(s_cols))}"
        return res
    sr, orows = _rows(spark_pdf), _rows(oracle_pdf)
    if sr == orows:
        res["status"] = "ok"
    else:
        res["status"] = "values"
        diff_s = [r for r in sr if r not in set(orows)][:3]
        diff_o = [r for r in orows if r not in set(sr)][:3]
        res["detail"] = f"cols={s_cols} spark-only={diff_s} oracle-only={diff_o}"
    types = {}
    for c in s_cols:
        st, ot = str(spark_pdf[c].dtype), str(oracle_pdf[c].dtype)
        if st != ot:
            types[c] = (st, ot)
    if types:
        res["dtype_diff"] = types
    return res


def main(argv: list[str]) -> int:
    from fairplay.plans.catalog import load_all
    from fairplay.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(load_all())
    spark = local_session(8)
    if names == ["--write-doubles"]:
        from fairplay.plans.catalog import write_double_columns

        print(len(write_double_columns(spark, sf_dir)), "jobs recorded")
        return 0
    con = duckdb_connection(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "status": "error", "detail": repr(e)[:500]}
        if r["status"] not in ("ok", "no-sql"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok-or-no-sql")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
