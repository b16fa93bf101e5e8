"""Run catalog queries in Spark and their SQL in DuckDB; compare rows, columns and values.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

STRICT = bool(os.environ.get("ORACLE_STRICT"))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def canon(v) -> str:
    if v is None:
        return "∅"
    if isinstance(v, float) and math.isnan(v):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        d = decimal.Decimal(v)
        return format(d.normalize(), "f") if d == d.to_integral_value() or True else str(d)
    if isinstance(v, float):
        return repr(v) if STRICT else repr(float(f"{v:.12g}"))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def digest(rows: list[tuple]) -> str:
    lines = sorted("|".join(canon(x) for x in r) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def spark_rows(df):
    cols = sorted(df.columns)
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return cols, out, {f.name: f.dataType.simpleString() for f in df.schema.fields}


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    types = dict(zip(names, [str(t) for t in rel.types]))
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(r[i] for i in idx) for r in data], types


_TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "date": "DATE", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT", "float": "FLOAT"}


def type_mismatches(st: dict, dt_: dict) -> list[str]:
    out = []
    for c, t in st.items():
        want = _TYPE_MAP.get(t, t.upper())
        if dt_.get(c) != want:
            out.append(f"{c}: spark {t} vs duck {dt_.get(c)}")
    return out


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    from basketry.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in sorted(qs):
        if only and k not in only:
            continue
        t0 = time.time()
        try:
            sc, sr, st = spark_rows(qs[k](spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"ROWS {k}: {len(sr)} rows ({ts:.1f}s)")
            continue
        try:
            dc, dr, dtypes = duck_rows(con, sqls[k])
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        msgs = []
        if sc != dc:
            msgs.append(f"columns spark={sc} duck={dc}")
        if len(sr) != len(dr):
            msgs.append(f"rows spark={len(sr)} duck={len(dr)}")
        if not msgs and digest(sr) != digest(dr):
            a = sorted("|".join(canon(x) for x in r) for r in sr)
            b = sorted("|".join(canon(x) for x in r) for r in dr)
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            msgs.append(f"values differ, e.g. {diff}")
        if msgs:
            bad += 1
            print(f"FAIL {k}: " + "; ".join(msgs))
            print(f"     types spark={st}\n           duck={dtypes}")
        else:
            tm = type_mismatches(st, dtypes)
            print(f"ok   {k}: {len(sr)} rows ({ts:.1f}s)" + (f"  TYPES {tm}" if tm else ""))
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
