"""Comparing a query with its SQL equivalent in DuckDB, as sets of rows with repetitions."""

from __future__ import annotations

import datetime
import json
import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}"
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{source}'")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return tuple(value) if isinstance(value, list) else value


def compare(spark, folder: str, query, sql: str) -> tuple[int, Counter, Counter]:
    """Rows of the query, and what only the query and only the SQL has."""
    df = query(spark, folder)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    result = connection(folder).sql(sql)
    assert sorted(result.columns) == names, (result.columns, names)
    order = [result.columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    return sum(got.values()), got - want, want - got


def isolated(module: str, names: list[str], folder: str, cwd) -> dict[str, list[str]]:
    """Rows of queries, as JSON, from workers that cannot import the package."""
    here = Path(__file__).resolve().parent
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, here / "isolated.py", here.parent, module, FOLDER if folder is None else folder, *names], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    said = [json.loads(line) for line in run.stdout.splitlines() if line.startswith("{")]
    return {x["name"]: x["rows"] for x in said}


def as_json(df) -> list[str]:
    return sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in df.collect())
