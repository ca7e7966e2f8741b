"""Run registered Spark queries and their DuckDB oracles side by side.

    python tests/oracle_check.py [/root/testdata/sf0.01] [key ...]

Compares row count, column names and types, and the multiset of rows (columns
sorted by name, values rendered as text, floats to 9 significant digits).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fieldwork.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return names, out


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
          "boolean": "BOOLEAN", "date": "DATE"}


def type_mismatches(spark_schema, duck_columns, duck_types):
    duck = dict(zip(duck_columns, [str(t) for t in duck_types]))
    out = {}
    for f in spark_schema.fields:
        st = _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if st != duck.get(f.name):
            out[f.name] = (st, duck.get(f.name))
    return out


def duck_conn(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def compare(spark, sf_dir, key, fn, sql, con):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    s_cols = df.columns
    t_spark = time.time() - t0
    if sql is None:
        return {"key": key, "status": "rows-only", "rows": len(s_rows), "spark_s": round(t_spark, 2)}
    t1 = time.time()
    rel = con.sql(sql)
    types_bad = type_mismatches(df.schema, rel.columns, rel.types)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    t_duck = time.time() - t1
    sn, sv = canon(s_cols, s_rows)
    dn, dv = canon(d_cols, d_rows)
    status = "ok"
    detail = ""
    if sn != dn:
        status, detail = "schema", f"spark={sn} duck={dn}"
    elif len(sv) != len(dv):
        status, detail = "rows", f"spark={len(sv)} duck={len(dv)}"
    elif sv != dv:
        status = "values"
        diff = [(a, b) for a, b in zip(sv, dv) if a != b][:1]
        detail = repr(diff)[:600]
    elif types_bad:
        status, detail = "types", repr(types_bad)
    return {"key": key, "status": status, "rows": len(s_rows), "spark_s": round(t_spark, 2),
            "duck_s": round(t_duck, 2), "detail": detail}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")]
    from fieldwork.session import get_session
    import __spark_entry__ as E
    spark = get_session("local[8]", 8)
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck_conn(sf_dir)
    bad = 0
    for key in keys or list(qs):
        try:
            r = compare(spark, sf_dir, key, qs[key], oracle.get(key), con)
        except Exception as e:  # report and go on
            r = {"key": key, "status": "error", "detail": repr(e)[:800]}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print(f"{len(keys or qs) - bad} passed, {bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
