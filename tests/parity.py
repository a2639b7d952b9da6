"""Compare registered queries with their SQL on the given tables.

    python -m tests.parity [folder] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
FOLDER = "/root/testdata/sf0.01"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return con


def _cell(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


def _rows(names: list[str], rows: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("\x1f".join(_cell(r[i]) for i in order) for r in rows)


def _kind(text: str) -> str:
    text = text.lower()
    if text in ("bigint", "int64", "long"):
        return "bigint"
    if text in ("int", "integer", "int32"):
        return "int"
    if text in ("string", "varchar"):
        return "string"
    return text


def compare(spark, con, name: str, queries: dict, sql: dict, folder: str) -> dict:
    began = time.time()
    df = queries[name](spark, folder)
    mine = [tuple(r) for r in df.collect()]
    took = time.time() - began
    out = {"name": name, "rows": len(mine), "spark_s": round(took, 2)}
    if name not in sql:
        return {**out, "status": "rows-only"}
    began = time.time()
    relation = con.execute(sql[name])
    columns = [d[0] for d in relation.description]
    theirs = relation.fetchall()
    out["sql_s"] = round(time.time() - began, 2)
    described = con.execute(f"DESCRIBE {sql[name]}").fetchall()
    left, right = _rows(df.columns, mine), _rows(columns, theirs)
    same = hashlib.md5("\n".join(left).encode()).digest() == hashlib.md5("\n".join(right).encode()).digest()
    kinds = {c: (_kind(t), _kind(dict((d[0], d[1]) for d in described).get(c, "?"))) for c, t in df.dtypes}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    ok = same and sorted(df.columns) == sorted(columns) and not odd
    out["status"] = "ok" if ok else "DIFFERENT"
    if odd:
        out["types"] = odd
    if not same:
        out["counts"] = (len(left), len(right))
        out["only_spark"] = sorted(set(left) - set(right))[:3]
        out["only_sql"] = sorted(set(right) - set(left))[:3]
    return out


def main(arguments: list[str]) -> int:
    import __spark_entry__ as entry
    from quaver.session import local_session

    folder = FOLDER
    if arguments and os.path.isdir(arguments[0]):
        folder = arguments.pop(0)
    spark, con = local_session(), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in arguments or queries:
        try:
            result = compare(spark, con, name, queries, sql, folder)
        except Exception as problem:
            result = {"name": name, "status": "ERROR", "problem": str(problem)[:1500]}
        bad += result["status"] in ("DIFFERENT", "ERROR")
        print({k: (str(v)[:900] if k.startswith("only") else v) for k, v in result.items()}, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
