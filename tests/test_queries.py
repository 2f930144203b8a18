"""Every query against its SQL in DuckDB on the smallest tables, or the next size where those give no rows."""

import math
from pathlib import Path

import duckdb
import pytest

from helioscope import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
SF = "/root/testdata/sf0.001"
#: These need miners that stay for weeks, which the smallest tables don't have.
LARGER = {"community_chance", "community_combined", "community_components", "community_distinct", "community_layers", "scoring_replacement_gap", "telemetry_likeness", "telemetry_observability"}


def folder(name):
    return SF.replace("0.001", "0.01") if name in LARGER else SF


@pytest.fixture(scope="module")
def ducks():
    made = {}
    for path in (SF, SF.replace("0.001", "0.01")):
        con = made[path] = duckdb.connect()
        for p in Path(path).glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return made


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda x: None if x is None else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) and not math.isnan(x) else str(x)
    return [columns[i] for i in order], sorted([tuple(cell(r[i]) for i in order) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, ducks, name):
    df = QUERIES[name](spark, folder(name))
    want = ducks[folder(name)].sql(SQL[name])
    got = rows(df.columns, [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in df.collect()])
    assert got == rows(want.columns, want.fetchall())
    assert got[1]
