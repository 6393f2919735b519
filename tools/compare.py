"""Run registered queries against their SQL checks and report differences.

usage: python tools/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from reelyard.catalogue import entries
from reelyard.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0 if value else 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        ([plain(r[i]) for i in order] for r in rows), key=str
    )


FAMILY = {
    "bigint": "int", "int": "int", "integer": "int", "smallint": "int", "tinyint": "int",
    "hugeint": "hugeint", "double": "double", "float": "float", "string": "text",
    "varchar": "text", "boolean": "bool",
}


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = local_session(8, 8)
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    bad = 0
    for name, item in entries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = item.run(spark, sf_dir)
            got = df.collect()
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        except Exception as error:  # report and go on
            bad += 1
            print(f"FAIL {name}: spark {type(error).__name__}: {str(error)[:1500]}")
            continue
        spent = time.time() - start
        if item.sql is None:
            print(f"ok   {name} rows={len(got)} {spent:.2f}s (no sql)")
            continue
        try:
            cursor = con.execute(item.sql)
            want_types = {d[0]: str(d[1]).lower() for d in cursor.description}
            want = cursor.fetchall()
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: sql {str(error)[:1500]}")
            continue
        cols_a, rows_a = table_rows(list(types), got)
        cols_b, rows_b = table_rows(list(want_types), want)
        notes = []
        if cols_a != cols_b:
            notes.append(f"columns {cols_a} vs {cols_b}")
        for c in set(types) & set(want_types):
            a, b = FAMILY.get(types[c], types[c]), FAMILY.get(want_types[c], want_types[c])
            if a != b:
                notes.append(f"type {c}: {types[c]} vs {want_types[c]}")
        if rows_a != rows_b:
            only_a = [r for r in rows_a if r not in rows_b][:3] if len(rows_a) < 20000 else []
            only_b = [r for r in rows_b if r not in rows_a][:3] if len(rows_a) < 20000 else []
            if not only_a and not only_b:
                diff = [(a, b) for a, b in zip(rows_a, rows_b) if a != b][:2]
                only_a = diff
            notes.append(f"rows {len(rows_a)} vs {len(rows_b)}\n   spark {only_a}\n   sql   {only_b}")
        bad += bool(notes)
        print(f"{'FAIL' if notes else 'ok  '} {name} rows={len(got)} {spent:.2f}s {'; '.join(notes)}")
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
