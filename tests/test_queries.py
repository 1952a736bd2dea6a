"""Every registered query against its SQL on the smallest data."""

import glob
import hashlib
import json
import os
import re

import duckdb
import pytest
from pyspark.sql import Row

import __spark_entry__ as entry

#: Rows and a digest of what queries without SQL gave on the smallest data when their results were checked; ``GOLDENS=write`` notes them anew.
GOLDENS = os.path.join(os.path.dirname(__file__), "{}goldens.json")
NAMES = list(entry.queries())


def golden_file(name):
    """Those of the subpackage's queries lie beside its tests."""
    return GOLDENS.format("llm/" if re.match(r"p[2-9]_", name) else "")


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect(config={"memory_limit": "6GB", "temp_directory": ""})
    for p in glob.glob(data + "/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _plain(x, digits=5):
    if isinstance(x, float):
        return repr(round(x, digits) + 0.0)
    if isinstance(x, Row):
        x = x.asDict()
    if isinstance(x, dict):
        return repr({k: _plain(v, digits) for k, v in x.items()})
    if isinstance(x, (list, tuple)):
        return repr([_plain(y, digits) for y in x])
    return str(x)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, data, name):
    got = entry.queries()[name](spark, data)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        rows = sorted(tuple(_plain(x, 3) for x in r) for r in got.collect())
        found = [len(rows), hashlib.md5(repr((sorted(got.columns), rows)).encode()).hexdigest()]
        path = golden_file(name)
        known = json.load(open(path)) if os.path.exists(path) else {}
        if os.environ.get("GOLDENS") == "write":
            json.dump(known | {name: found}, open(path, "w"), indent=1, sort_keys=True)
            return
        assert known[name] == found
        return
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in got.columns]
    a = sorted(tuple(map(_plain, r)) for r in got.collect())
    b = sorted(tuple(_plain(r[k]) for k in place) for r in want.fetchall())
    assert a == b


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["pair_hash", "i", "j", "sim"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
