"""Compare registered queries with their SQL in DuckDB: python tools/check.py [dir] [name ...]"""

from __future__ import annotations

import decimal
import sys
import time

import duckdb

from siftline.plans import catalog
from siftline.session import local_session
from siftline.sources.tables import SCHEMAS


TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "VARCHAR[]": "array<string>", "BIGINT[]": "array<bigint>",
}


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows as text, columns by name, floats to 6 places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(value):
        if value is None:
            return "∅"
        if isinstance(value, decimal.Decimal):
            value = float(value)
        if isinstance(value, float):
            return repr(round(value, 6) + 0.0)
        if isinstance(value, (list, tuple)):
            return "[" + ", ".join(show(v) for v in value) + "]"
        if isinstance(value, dict):
            return "{" + ", ".join(f"{k}: {show(v)}" for k, v in value.items()) + "}"
        return str(value)

    return sorted(tuple(show(row[i]) for i in order) for row in rows)


def main() -> None:
    args = sys.argv[1:]
    directory = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = catalog.queries(), catalog.oracle_sql()
    names = args or list(queries)
    bad = []
    for name in names:
        db = duckdb.connect()
        for table in SCHEMAS:
            db.execute(f"create view {table} as select * from '{directory}/{table}.parquet'")
        started = time.time()
        try:
            df = queries[name](spark, directory)
            got = [tuple(r) for r in df.collect()]
        except Exception as error:  # report and go on
            bad.append(name)
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - started
        if name not in sql:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        started = time.time()
        try:
            cursor = db.execute(sql[name])
            kinds = {d[0]: str(d[1]) for d in cursor.description}
            want = cursor.fetchall()
        except Exception as error:
            bad.append(name)
            print(f"SQL!  {name}: {str(error)[:800]}", flush=True)
            continue
        sql_took = time.time() - started
        names_match = sorted(kinds) == sorted(df.columns)
        a, b = canonical(df.columns, got), canonical(list(kinds), want) if names_match else None
        huge = [c for c, k in kinds.items() if "HUGEINT" in k]
        pairs = {c: (t, TYPES.get(kinds.get(c), kinds.get(c))) for c, t in df.dtypes}
        odd = {c: p for c, p in pairs.items() if p[0] != p[1]}
        note = f" types {odd}" if odd else ""
        if a == b and not huge:
            print(f"ok    {name}: {len(got)} rows {took:.1f}s sql {sql_took:.1f}s{note}", flush=True)
        else:
            bad.append(name)
            print(f"DIFF  {name}: {len(got)} vs {len(want)} rows; cols {df.columns} vs {list(kinds)}; huge {huge}{note}", flush=True)
            if b is not None:
                left, right = set(a), set(b)
                print("   only spark:", sorted(left - right)[:3], "\n   only sql:  ", sorted(right - left)[:3], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
