"""Run registered queries against their DuckDB twins: python tests/check.py [sf_dir] [name or prefix* ...]"""

from __future__ import annotations

import datetime
import decimal
import fnmatch
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return repr(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, function, sql, sf_dir):
    """None when equal, otherwise a short text."""
    df = function(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not rows:
        return "no rows"
    if len(rows) != len(expected):
        return f"rows {len(rows)} != {len(expected)}"
    ours, theirs = sorted_rows(df.columns, rows), sorted_rows(names, expected)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(rows)} differ, first {wrong[0]}"[:700]
    types = {d[0]: str(d[1]) for d in result.description}
    loose = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if (t in ("bigint", "int")) != (types[c] in ("BIGINT", "INTEGER"))]
    return f"(types) {loose}" if loose else None


def main() -> int:
    from batchloom.plans import ORACLES, QUERIES
    from batchloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or ["*"]
    spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name, function in QUERIES.items():
        if not any(fnmatch.fnmatch(name, w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, function, ORACLES.get(name), sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - start:.2f}s {'' if ORACLES.get(name) else '[rows only]'} {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
