"""Run queries and their SQL side by side: python tests/check_sql.py [sf_dir] [name part ...]"""

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, list):
        return tuple(normal(v) for v in value)
    return value


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(normal(r[k]) for k in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, run, sql, sf_dir):
    """None when both sides agree, else what differs."""
    frame = run(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} / {sorted(names)}"
    spark_types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
            "timestamp": "TIMESTAMP", "date": "DATE"}
    types = {d[0]: str(d[1]) for d in cursor.description}
    odd = {n: (spark_types[n], types[n]) for n in names if same.get(spark_types[n]) != types[n]}
    a, b = normal_rows(frame.columns, got), normal_rows(names, want)
    if a != b:
        set_a, set_b = set(a), set(b)
        only_a, only_b = [x for x in a if x not in set_b][:3], [x for x in b if x not in set_a][:3]
        return f"{len(a)} / {len(b)} rows; spark {only_a} sql {only_b}"
    if not a:
        return "both empty"
    return f"TYPES {odd}" if odd else None


def main():
    from tallyspark.queries import QUERIES, SQL
    from tallyspark.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = local_session("8"), connect(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, run, SQL.get(name), sf_dir)
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:1500]
        bad += problem is not None
        mark = "ok" if problem is None else "BAD"
        print(f"{mark:4}{name:32}{time.time() - start:6.1f}s{'' if name in SQL else '  (rows only)'}", problem or "", flush=True)
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
